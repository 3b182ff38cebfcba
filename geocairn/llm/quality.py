"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Each text gives counts (words, their characters, symbols, repeated lines, words in repeated five-word windows). Fixed rules on these
fail some documents. The others are held against their language and source: their statistics, transformed so that ordinary texts
scatter about evenly, go through a minimum-covariance-determinant estimate of each (language, source) group. From several starts
the share of rows nearest by Mahalanobis distance gives the next mean and covariance; the start that leads to the least determinant goes on until the
determinant falls no more, and the rows that then lie within a chi-square bound are weighed in anew. A group's estimate is
drawn towards its language's, that towards all documents', and that towards ordinary prose, the more the fewer its rows, so groups of
any size are judged alike. Rows beyond a chi-square bound of the final distance are rejected.

Groups are only ever summed (counts, sums, products, histograms of distances), and rows meet their group's estimate by a salted key, so a
hot group is spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, quoted

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"
#: Share of a group's rows that a step's mean and covariance come from.
SHARE = 0.75
#: Steps from each start, and at most from the best of them.
FIRST_STEPS, STEPS = 2, 12
#: Rows' weight of what a group's estimate is drawn towards.
DRAW = 50.0
#: Chi-square with 5 degrees of freedom is above this with a probability of 1.5e-7.
BOUND = 40.0
#: Chi-square factors that make the covariance of the nearest 75 %, and of those within REWEIGHT, that of a whole normal group, 5 dimensions.
CONSISTENCY, REWEIGHT, REWEIGHT_CONSISTENCY = 1.412, 12.83, 1.055
#: Least variance of each statistic: scatter below these steps of the transformed statistics says nothing of quality.
FLOORS = (0.05**2, 0.1**2, 0.05**2, 0.15**2, 0.15**2)
#: Mean and variance of each statistic in ordinary prose.
PROSE = ((1.65, 0.3**2), (0.05, 0.15**2), (0.2, 0.1**2), (0.0, 0.3**2), (0.0, 0.3**2))
#: Ordinary words added to each text when its statistics are taken.
PRIOR_WORDS = 20
STATS = ("x0", "x1", "x2", "x3", "x4")
#: Parts that the rows of a group are dealt into where they meet its estimate.
SALT = 32


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words of the array that lie in a five-word window found twice or more in it.

    Windows are compared by 64-bit hash. Only where one repeats are they sorted to find which; a window that starts at p then adds the
    words from p up to the next repeated window, five at most.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        starts = _let(
            pairs,
            lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"])),
        )
        return _let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines (those with a word), n_dup_lines, n_repeat_words, n_capitals (long) and base_failed."""
    words = F.regexp_extract_all("__t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(
        "__s",
        _let(
            words,
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
        ),
    )
    out = out.withColumn("__dup", _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))))
    return out.withColumns(
        {
            "n_words": F.col("__s.n_words"),
            "word_chars": F.length(F.translate("__t", SPACES, "")).cast("long"),
            "n_symbols": (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"),
            "n_capitals": (F.length("__t") - F.length(F.translate("__t", CAPITALS, ""))).cast("long"),
            "n_lines": F.col("__dup.n").cast("long"),
            "n_dup_lines": F.col("__dup.again").cast("long"),
            "n_repeat_words": F.col("__s.n_repeat_words"),
            "base_failed": (F.col("__s.n_words") < MIN_WORDS) | (100 * F.col("__s.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__s.n_words")),
        }
    ).drop("__t", "__s", "__dup")


def vector() -> list[Column]:
    """The transformed statistics: log of the mean word length without symbols, roots of the shares of symbols, of capitals, of lines
    that repeat and of words in repeated windows.

    Each is drawn towards that of PRIOR_WORDS ordinary words, so that a short text's chance deviations don't stand out.
    """
    n = (F.col("n_words") + PRIOR_WORDS).cast("double")
    chars = F.col("word_chars") + 5 * PRIOR_WORDS
    return [
        F.log((chars - F.col("n_symbols")) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt((F.col("n_capitals") + 1) / chars),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10)), F.sqrt(F.col("n_repeat_words") / n),
    ]


_ALL = range(len(STATS))
_LOWER = [(i, j) for i in _ALL for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """keys with n, m0.. (means) and c00, c10, c11.. (covariances times factor, with floors on the diagonal)."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)], *[F.covar_pop(STATS[i], STATS[j]).alias(f"v{i}{j}") for i, j in _LOWER])
    return sums.select(*keys, "n", *[f"m{i}" for i in _ALL], *[(F.col(f"v{i}{j}") * factor + (FLOORS[i] if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _LOWER])


def _inverted(model: DataFrame) -> DataFrame:
    """model (m0.., c00..) with w00, w10.., the inverse of the covariance, and logdet, log of its determinant: one sweep after the other."""
    p = len(STATS)
    matrix = F.array(*[F.col(f"c{max(i, j)}{min(i, j)}") for i in _ALL for j in _ALL])

    def sweep(s: Column, k: Column) -> Column:
        a = s["a"]
        at = lambda i, j: F.get(a, i * p + j)
        d = F.greatest(at(k, k), F.lit(1e-12))

        def entry(t: Column) -> Column:
            i, j = F.floor(t / p).cast("int"), t % p
            return F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), F.get(a, t) / d).otherwise(F.get(a, t) - at(i, k) * at(k, j) / d)

        return F.struct(F.transform(F.sequence(F.lit(0), F.lit(p * p - 1)), entry).alias("a"), (s["logdet"] + F.log(d)).alias("logdet"))

    swept = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.struct(matrix.alias("a"), F.lit(0.0).alias("logdet")), sweep)
    out = model.withColumn("__swept", swept)
    return out.withColumns({**{f"w{i}{j}": -F.col("__swept.a")[i * p + j] for i, j in _LOWER}, "logdet": F.col("__swept.logdet")}).drop("__swept")


def _with_distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (__g, __salt, STATS, ...) with __d2, the squared Mahalanobis distance from the model of their __g, for each model of it."""
    each = _inverted(model).drop(*[f"c{i}{j}" for i, j in _LOWER], "n", "logdet").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = rows.join(each, ["__g", "__salt"])
    off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(STATS)]
    d2 = reduce(lambda a, b: a + b, [(1.0 if i == j else 2.0) * F.col(f"w{i}{j}") * off[i] * off[j] for i, j in _LOWER])
    return met.withColumn("__d2", F.greatest(d2, F.lit(0.0))).drop(*[f"m{i}" for i in _ALL], *[f"w{i}{j}" for i, j in _LOWER])


def _nearest(near: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The rows of each key whose distance is in the lowest bins (64 to a doubling) that together hold `share` of them."""
    near = near.withColumn("__bin", F.when(F.col("__d2") < 1e-9, F.lit(-2000)).otherwise(F.floor(F.log2("__d2") * 64)).cast("int"))
    bins = near.groupBy(*keys, "__bin").agg(F.count("*").alias("__b"))
    order = Window.partitionBy(*keys).orderBy("__bin")  # bins, not rows: some thousands of a group at most
    bins = bins.withColumns({"__below": F.sum("__b").over(order) - F.col("__b"), "__all": F.sum("__b").over(Window.partitionBy(*keys))})
    last = bins.where(F.col("__below") < F.ceil(F.col("__all") * share)).groupBy(*keys).agg(F.max("__bin").alias("__last"))
    last = last.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return near.join(last, [*keys, "__salt"]).where(F.col("__bin") <= F.col("__last"))


def _starts(rows: DataFrame) -> DataFrame:
    """__g, __s and the model of each start: medians with the quartiles' spreads; with these and the correlations of tanh of the standardised
    rows; with those of their directions; and the mean and covariance of the half nearest to the medians."""
    quartiles = rows.groupBy("__g").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i, s in enumerate(STATS)])
    centre = cut(quartiles.select("__g", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in _ALL], *[(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2.0)) + FLOORS[i]).alias(f"c{i}{i}") for i in _ALL]))
    zero = {f"c{i}{j}": F.lit(0.0) for i, j in _LOWER if i != j}
    plain = centre.withColumns({"n": F.lit(0).cast("long"), **zero})
    spread = centre.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    z = [((F.col(s) - F.col(f"m{i}")) / F.sqrt(f"c{i}{i}")).alias(s) for i, s in enumerate(STATS)]
    standard = rows.join(spread, ["__g", "__salt"]).select("__g", *z)
    length = F.sqrt(reduce(lambda a, s: a + F.col(s) * F.col(s), STATS, F.lit(1e-12)))
    bent = [standard.select("__g", *[F.tanh(s).alias(s) for s in STATS]), standard.select("__g", *[(F.col(s) / length).alias(s) for s in STATS])]
    out = [plain]
    for rows_ in bent:
        of = rows_.groupBy("__g").agg(*[F.covar_pop(STATS[i], STATS[j]).alias(f"v{i}{j}") for i, j in _LOWER])
        r = {f"c{i}{j}": F.col(f"v{i}{j}") / F.sqrt((F.col(f"v{i}{i}") + 1e-6) * (F.col(f"v{j}{j}") + 1e-6)) * F.sqrt(F.col(f"c{i}{i}") * F.col(f"c{j}{j}")) for i, j in _LOWER if i != j}
        out.append(centre.join(of, "__g").withColumns({"n": F.lit(0).cast("long"), **r}))
    out.append(_moments(_nearest(_with_distance(rows, plain), ["__g"], 0.5), ["__g"], 1.0))
    columns = ["__g", "n", *[f"m{i}" for i in _ALL], *[f"c{i}{j}" for i, j in _LOWER]]
    return reduce(DataFrame.unionByName, [m.select(*columns, F.lit(k).alias("__s")) for k, m in enumerate(out)])


def least_determinants(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Per __g of rows (__g, __salt, STATS): the model of least determinant that the starts lead to, reweighted, with n, the group's rows."""
    models = cut(_starts(rows))
    for _ in range(FIRST_STEPS):
        models = cut(_moments(_nearest(_with_distance(rows, models), ["__g", "__s"], share), ["__g", "__s"], CONSISTENCY))
    fields = ["n", *[f"m{i}" for i in _ALL], *[f"c{i}{j}" for i, j in _LOWER], "logdet"]
    best = cut(_inverted(models).groupBy("__g").agg(F.min_by(F.struct(*fields), F.struct("logdet", "__s")).alias("b")).select("__g", "b.*"))
    going = best  # groups whose determinant fell in the last step
    for _ in range(steps):
        after = _moments(_nearest(_with_distance(rows, going.drop("logdet")), ["__g"], share), ["__g"], CONSISTENCY)
        going = cut(_inverted(after).select("__g", *fields).join(going.select("__g", F.col("logdet").alias("__old")), "__g").where(F.col("logdet") < F.col("__old") - 1e-6).drop("__old"))
        if going.isEmpty():
            break
        best = cut(best.join(going.select("__g"), "__g", "left_anti").unionByName(going))
    sizes = rows.groupBy("__g").agg(F.count("*").alias("n"))
    within = _with_distance(rows, best.drop("logdet")).where(F.col("__d2") <= REWEIGHT)
    weighed = _moments(within, ["__g"], REWEIGHT_CONSISTENCY).drop("n")
    return cut(sizes.join(weighed, "__g"))


def _drawn(own: DataFrame, towards: DataFrame, on: str) -> DataFrame:
    """own (__g, n, model, and the key `on` of what it is drawn towards) with its model drawn towards that of `towards` (__g, model)."""
    other = towards.select(F.col("__g").alias(on), *[F.col(f"m{i}").alias(f"om{i}") for i in _ALL], *[F.col(f"c{i}{j}").alias(f"oc{i}{j}") for i, j in _LOWER])
    w = F.col("n") / (F.col("n") + DRAW)
    mean = [(w * F.col(f"m{i}") + (1 - w) * F.col(f"om{i}")).alias(f"m{i}") for i in _ALL]
    cov = [(w * F.col(f"c{i}{j}") + (1 - w) * F.col(f"oc{i}{j}")).alias(f"c{i}{j}") for i, j in _LOWER]
    return own.join(other, on).select("__g", "n", *mean, *cov)


def robust_distances(vectors: DataFrame, lang: str = "lang", source: str = "source", share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """vectors (with STATS) and __d2, the squared robust distance in their language and source."""
    part = lambda level, *c: F.xxhash64(F.lit(level), *[x for k in c for x in (F.col(k).isNull(), F.col(k).cast("string"))])
    keyed = vectors.withColumns({"__g0": part(0), "__g1": part(1, lang), "__g2": part(2, lang, source), "__salt": F.pmod(F.xxhash64(*STATS, F.monotonically_increasing_id()), F.lit(SALT)).cast("int")})
    keyed = cut(keyed)
    rows = keyed.select("__salt", *STATS, F.explode(F.array("__g0", "__g1", "__g2")).alias("__g"))
    models = least_determinants(rows, share, steps)
    levels = keyed.groupBy("__g0", "__g1", "__g2").agg(F.lit(0).alias("__0"))
    prose = models.join(levels.select(F.col("__g0").alias("__g")).distinct(), "__g").select(F.col("__g"), *[F.lit(m).alias(f"m{i}") for i, (m, _) in enumerate(PROSE)], *[F.lit(PROSE[i][1] if i == j else 0.0).alias(f"c{i}{j}") for i, j in _LOWER])
    every = _drawn(models.join(prose.select("__g"), "__g").withColumn("__up", F.col("__g")), prose, "__up")
    langs = cut(_drawn(models.join(levels.select(F.col("__g1").alias("__g"), F.col("__g0").alias("__up")).distinct(), "__g"), every, "__up"))
    groups = cut(_drawn(models.join(levels.select(F.col("__g2").alias("__g"), F.col("__g1").alias("__up")).distinct(), "__g"), langs, "__up"))
    return _with_distance(keyed.withColumn("__g", F.col("__g2")), groups).drop("__g", "__g0", "__g1", "__g2", "__salt")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", bound: float = BOUND, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2.

    Null text has no words and so fails; null languages and sources form groups of their own; a null id passes through; rows that
    repeat are judged each on its own; an empty table gives an empty result; other columns are ignored. Only documents that pass the
    fixed rules shape the estimates and can be rejected by them.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    stats = cut(statistics(named).drop("text"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = stats.where(~F.col("base_failed")).withColumns(dict(zip(STATS, vector(), strict=True)))
    judged = robust_distances(passed, "lang", "source", share, steps)
    judged = judged.select(*counts, F.coalesce(F.col("__d2") <= bound, F.lit(True)).alias("kept"), F.col("__d2").alias("distance2"))
    return judged.unionByName(stats.where("base_failed").select(*counts, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2")))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns; rows are matched by id, and rows of one id by its count of
    kept rows: all stay if one does."""
    names = docs.columns
    kept = quality_rules(docs, doc_id, **options).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col(doc_id).eqNullSafe(F.col("__kept")), "left_semi").select(*quoted(names))
