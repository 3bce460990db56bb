"""Rule-based document quality: base counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (words, pairs of words, pairs of word shapes) are counted: one over
texts that are known to be good, one over the whole raw corpus. A word's shape has runs of small letters,
capitals and digits replaced by one sign each, so it tells unusual writing from rare words. A document's score is the mean, over its n-grams, of
the logarithm of the ratio of the two smoothed probabilities. Documents at or above the threshold are
kept, provided that the base rules do not reject them.

Everything is built from DataFrame functions. The model has a fixed number of cells, whatever the size of
the corpus; it is folded into the plan as one array literal, so scoring is a pass over the texts
without a join or shuffle. Weights are whole millionths and their sum is exact: the verdict does not
depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import WHITE, hold, small, staged, words

CELLS = 1 << 15
SMOOTHING = 50.0  # occurrences at the corpus' own ratio that are added to every cell
THRESHOLD = -0.2
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
_MICRO = 1_000_000


def _next_to(a: str, b: str, ahead: int) -> Column:
    """Hash of each entry of ``a`` with the entry of ``b`` that stands ``ahead`` places further on."""
    n = F.greatest(F.size(b) - ahead, F.lit(0))
    return F.zip_with(F.slice(F.col(a), F.lit(1), n), F.slice(F.col(b), F.lit(ahead + 1), n), lambda x, y: F.xxhash64(x, y))


def _cell(hashed: str | Column, cells: int) -> Column:
    return F.pmod(hashed, F.lit(cells)).cast("int")


def _hashed(df: DataFrame) -> DataFrame:
    """Adds hashes of all words (``_x``) and word pairs (``_p``) of the array ``_w``, each word being read once."""
    df = hold(df, F.transform("_w", lambda x: F.xxhash64(x)).alias("_x"))
    return hold(df, _next_to("_x", "_x", 1).alias("_p"))


def _shape_hashes(text: str = "text") -> Column:
    shape = F.coalesce(F.col(text), F.lit(""))
    for letters, sign in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")):
        shape = F.regexp_replace(shape, letters, sign)
    return F.transform(words(shape), lambda x: F.xxhash64(F.lit("shape"), x))


def _with_shapes(df: DataFrame) -> DataFrame:
    """Adds ``_grams``: the hashes of all words, pairs of words and pairs of word shapes."""
    df = hold(df, _shape_hashes().alias("_y"))
    return hold(df, F.concat("_x", "_p", _next_to("_y", "_y", 1)).alias("_grams"))


def _windows_twice(df: DataFrame) -> DataFrame:
    """Adds ``_at``: the sorted starts of all 3-word windows that come twice or more in the text.

    Only a text in which a window comes twice is looked at closer. Half of each hash with the window's start makes one
    number, which sorts fast; windows that agree in that half with another one are compared by the whole hash.
    """
    df = hold(df, _next_to("_p", "_x", 2).alias("_h"))
    half = F.lit(-1 << 32)
    keys = F.sort_array(F.transform("_h", lambda h, i: h.bitwiseAND(half).bitwiseOR(i.cast("long"))))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    df = hold(df, F.when(some, keys).otherwise(F.array().cast("array<bigint>")).alias("_k"))

    def alike(a: str, same, number) -> Column:
        n = F.greatest(F.size(a) - 1, F.lit(0))
        both = F.zip_with(F.slice(F.col(a), F.lit(1), n), F.slice(F.col(a), F.lit(2), n), lambda x, y: F.when(same(x, y), F.array(number(x), number(y))))
        return F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))

    start = lambda key: key.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    df = hold(df, alike("_k", lambda x, y: F.shiftright(x, 32) == F.shiftright(y, 32), start).alias("_c"))
    df = hold(df, F.sort_array(F.transform("_c", lambda i: F.struct(F.get("_h", i).alias("h"), i.alias("i")))).alias("_s"))
    return hold(df, F.sort_array(alike("_s", lambda x, y: x["h"] == y["h"], lambda x: x["i"])).alias("_at"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, and ``_x`` and ``_p`` of :func:`_hashed`."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = hold(docs, words(text).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WHITE}]")).alias("_lines"))
    df = _windows_twice(_hashed(df))
    steps = F.zip_with(
        "_at", F.concat(F.array(F.lit(-3)), F.slice(F.col("_at"), F.lit(1), F.greatest(F.size("_at") - 1, F.lit(0)))),
        lambda x, before: F.least(F.lit(3), x - before),
    )
    covered = F.when(F.size("_at") == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x))
    return df.select(
        *docs.columns,
        "_x",
        "_p",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split(t, f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def fit_ratio(docs: DataFrame, trusted: DataFrame, cells: int = CELLS, smoothing: float = SMOOTHING) -> list[int]:
    """Log ratios, in millionths, of the target's and the raw corpus' probability of each of ``cells`` cells.

    ``docs`` (doc_id, text) is the raw corpus, ``trusted`` (doc_id) names the rows of it that form the
    target. All rows of both count. Without any target n-gram every ratio is 0. The trusted ids are
    broadcast if their counted number allows it. Only the table of cells comes to the driver.
    """
    trusted = small(staged(trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()), 16)
    marked = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_id"), "left")
    marked = hold(marked.select("text", F.col("_id").isNotNull().cast("long").alias("_good")), words("text").alias("_w"))
    grams = _with_shapes(_hashed(marked)).select("_good", F.explode("_grams").alias("_gram"))
    counts = grams.groupBy(_cell("_gram", cells).alias("cell")).agg(F.count("*").alias("raw"), F.sum("_good").alias("good"))
    totals = staged(counts)
    sums = totals.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    raw, good = float(sums["raw"] or 0), float(sums["good"] or 0)
    if not good:
        return [0] * cells
    p = lambda c, n: (F.col(c) + smoothing * n / raw) / F.lit(n * (1 + smoothing * cells / raw))
    ratio = F.round(F.log(p("good", good) / p("raw", raw)) * _MICRO).cast("long")
    model = [0] * cells  # a cell that no text has is never looked up
    for row in totals.select("cell", ratio.alias("ratio")).collect():  # one row per cell at most
        model[row["cell"]] = row["ratio"]
    return model


def score_documents(docs: DataFrame, model: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``llr`` (mean log ratio) and ``kept`` to every row.

    A null or white text has no words, fails the base rules and is not kept; its ``llr`` is 0.
    Rows are judged one by one, so repeated ids, null ids and further columns do not matter.
    """
    cells = len(model)
    counted = _with_shapes(base_counts(docs))
    literal = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # folded once by the optimizer
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda acc, h: acc + F.get(literal, _cell(h, cells)))
    n_grams = 3 * F.col("n_words") - 2
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = hold(counted, F.when(F.col("n_words") > 0, total).otherwise(F.lit(0)).alias("_sum"))
    good = ~failed & (F.col("_sum") >= n_grams * F.lit(round(threshold * _MICRO)))
    llr = F.when(F.col("n_words") > 0, F.col("_sum") / n_grams / _MICRO).otherwise(F.lit(0.0))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select(*docs.columns, *names, failed.alias("base_failed"), llr.alias("llr"), good.alias("kept"))


def judge_quality(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Fit on ``docs`` and ``trusted`` and score every row of ``docs``.

    Result columns are named as in :func:`score_documents`; columns of ``docs`` other than doc_id and text
    are not carried, so their names cannot clash.
    """
    slim = docs.select("doc_id", "text")
    return score_documents(slim, fit_ratio(slim, trusted)).drop("text")


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    model = fit_ratio(docs, trusted)
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return score_documents(packed, model).where("kept").select("_row.*")
