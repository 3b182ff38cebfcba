"""The training-data queries and the SQL that checks those which SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, common, hmm, licenses, lines, mixing, near, negatives, packing, pages, pipeline, quality, runs, tokencount, vectors


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(common.table(spark, sf_dir, "embeddings"))


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(common.table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(common.table(spark, sf_dir, "documents"), min_words=1)
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(common.table(spark, sf_dir, "documents"), packing.token_file("piece_bpe_32k.model"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(common.table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(common.cut(docs))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), packing.token_file("byte_bpe_50k.json"), context=packing.CONTEXT, max_loss=packing.MAX_LOSS)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(common.table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vec_id = common.table(spark, sf_dir, "embeddings"), F.col("vec_id")
    moved = rows.withColumn("label", F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine_negatives(moved, vec_id % 100 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", runs.repeated_tail(F.col("text"), common.crc_of(F.col("doc_id"))).alias("text"))
    found = runs.periodic_runs(planted).withColumn("r", runs.longest_run(F.col("runs")))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    exponent = F.floor(1000 * F.col("r.length") / F.col("r.period")).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period", exponent.alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(common.table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_hmm_scores": op2_hmm_scores,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mix_sources": op7_mix_sources,
    "op8_pack": op8_pack,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_page_text": op13_page_text,
    "pipeline": pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": r"""with d as (select doc_id, source, text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
        p as (select doc_id, source, generate_subscripts(ls, 1) - 1 as pos, trim(unnest(ls), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) as line from d),
        l as (select * from p where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 1),
        b as (select line, min((doc_id, pos)) as first from l group by line having count(distinct coalesce('0' || source, '1')) >= 6),
        g as (select doc_id, list_sort(list(pos)) as removed from l join b using (line) where (doc_id, pos) <> first group by doc_id),
        o as (select d.doc_id, text, ls, coalesce(removed, []) as removed from d left join g on d.doc_id = g.doc_id),
        t as (select *, case when len(removed) = 0 then text else array_to_string(list_filter(ls, lambda x, i: not list_contains(removed, i - 1)), chr(10)) end as kept from o)
        select doc_id, case when text is null then 0 else len(ls) end as n_lines, len(removed) as n_removed, removed::integer[] as removed, length(kept) as n_chars, md5(kept) as text_md5 from t""",
    "op1_embedding_dedup": r"""with recursive
        s as materialized (select vec_id, case when len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 then embedding::double[] end as v from embeddings),
        e as materialized (select a.vec_id as a, b.vec_id as b from s a join s b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.9::double),
        r(id, c) as (select a, b from e union select r.id, e.b from r join e on r.c = e.a),
        g as (select id, min(c) as c from r group by id), n as (select a as id, count(*) as n from e group by a)
        select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(c, vec_id)) as component_id, c is null or c >= vec_id as kept from s left join g on g.id = vec_id left join n on n.id = vec_id""",
    "op6_jaccard_join": r"""with recursive
        d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        g as materialized (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
        n as materialized (select doc_id, count(*) as n from g group by doc_id),
        o as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by all),
        e as materialized (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where k * 5 >= (x.n + y.n - k) * 4),
        r(id, c) as (select a, b from e union select r.id, e.b from r join e on r.c = e.a),
        m as (select id, min(c) as c from r group by id), l as (select a as id, count(*) as l from e group by a)
        select d.doc_id, coalesce(l, 0) as n_links, least(d.doc_id, coalesce(c, d.doc_id)) as class_id, c is null or c >= d.doc_id as kept, coalesce(n.n, 0) as n_shingles
        from d left join n using (doc_id) left join m on m.id = d.doc_id left join l on l.id = d.doc_id""",
    "op11_hard_negatives": """with r as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
            where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        u as (select id, min({'label': label, 'v': v}) as b from r group by id),
        s as materialized (select x.id as anchor_id, y.id as other, x.b.label = y.b.label as same, list_inner_product(x.b.v, y.b.v)::bigint as score from u x join u y on x.id <> y.id and len(x.b.v) = len(y.b.v) where x.id % 100 = 0),
        p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
        select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::integer as rank, other as negative_id, positive_score, score as negative_score
        from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score qualify rank <= 10""",
    "op7_mix_sources": r"""with d as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, case when source is null then '1' else '0' || source end as k, md5(coalesce(doc_id::varchar, '')) as md from documents),
        t as (select k, sum(size)::bigint as source_size from d group by k),
        w as (select *, ([5, 2, 1])[(row_number() over (order by k) - 1) % 3 + 1]::double as w, source_size * 2::double as cap from t),
        s as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as share from w window b as (order by cap / w, k rows between unbounded preceding and 1 preceding)),
        g as (select k, source_size, least(cap, max(share) over () * w) as target, ('0x' || substr(md5('7:' || k), 1, 8))::bigint / 4294967296::double as start from s),
        p as (select d.*, source_size, target, start, case when source_size > 0 then target / source_size else 0 end as rate,
            row_number() over (partition by k order by case when size < 16 then size else length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)::bigint) & 7) end, md, doc_id) as place from d join g using (k)),
        c as (select *, (floor(rate * place + start) - floor(rate * (place - 1) + start))::bigint as copies from p)
        select doc_id, size::bigint as size, source_size, target, copies * size as taken, copies from c""",
}
