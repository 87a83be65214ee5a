"""Document rules and host verdicts (operator 5); columns and joins only.

Rules judge documents from statistics of their words and lines. Failures are counted by host, the hosts' rates
are shrunk towards an empirical beta prior, and hosts whose shrunken rate is too high lose all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
MIN_HOST_DOCS = 20

BROADCAST_HOSTS = 1_000_000


# Words covered by the windows of three that occur twice in the array ``words``. Windows are sorted by hash; neighbours
# of one hash are the repeated ones. Only texts that have some go on to sort the windows with their places.
_REPEAT_WORDS = """
  transform(array(transform(sequence(1, greatest(size(words) - 2, 1)),
                            i -> xxhash64(get(words, i - 1), get(words, i), get(words, i + 1)))), h ->
    if(size(words) < 4 or size(array_distinct(h)) = size(h), 0L,
      transform(array(array_sort(transform(h, (x, i) -> struct(x as x, i as i)))), s ->
        transform(array(array_sort(transform(
            filter(sequence(0, size(s) - 1), j -> s[j].x = get(s, j - 1).x or s[j].x = get(s, j + 1).x),
            j -> s[j].i))), p ->
          cast(aggregate(sequence(0, size(p) - 2), 3, (n, j) -> n + least(3, p[j + 1] - p[j])) as bigint))[0])[0]))[0]"""


def word_rules(text: str, min_words: int, max_repeat_percent: int) -> Column:
    """struct<n_words, n_repeat_words, base_failed>. Each array is bound to a name within one expression, so that
    the optimizer can't repeat it."""
    words = f"filter(split(coalesce({text}, ''), '[ \\\\x09-\\\\x0D]+'), w -> w != '')"
    counted = f"struct(cast(size(words) as bigint) as n_words, {_REPEAT_WORDS} as n_repeat_words)"
    failed = f"c.n_words < {min_words} or 100 * c.n_repeat_words > {max_repeat_percent} * c.n_words"
    return F.expr(f"""transform(transform(array({words}), words -> {counted}), c ->
        struct(c.n_words as n_words, c.n_repeat_words as n_repeat_words, {failed} as base_failed))[0]""")


def base_rules(docs: DataFrame, text_column: str = "text", min_words: int = MIN_WORDS,
               max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Words are runs of anything but space and \\x09-\\x0D; null is empty. A line (split at \\n) is a duplicate if it has a
    word and equals an earlier one. A word is repeated if it lies in a window of three words that the text holds twice or
    more. A document fails with fewer than ``min_words`` words, or if more than ``max_repeat_percent`` of a hundred of its
    words are repeated; a null text has none and fails.
    """
    text = f"`{text_column}`"
    t = f"coalesce({text}, '')"
    lines = f"filter(split({t}, '\\n', -1), s -> s rlike '[^ \\\\x09-\\\\x0D]')"
    judged = docs.withColumns({
        "word_chars": F.expr(f"cast(char_length(regexp_replace({t}, '[ \\\\x09-\\\\x0D]+', '')) as bigint)"),
        "n_symbols": F.expr(f"cast(char_length({t}) - char_length(translate({t}, '#*$%&|<>', '')) as bigint)"),
        "n_dup_lines": F.expr(
            f"transform(array({lines}), s -> cast(size(s) - size(array_distinct(s)) as bigint))[0]"),
        "_rules": word_rules(text, min_words, max_repeat_percent),
    })
    return judged.withColumns({c: F.col(f"_rules.{c}") for c in ("n_words", "n_repeat_words", "base_failed")}).drop("_rules")


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """host, n, failures, shrunk_rate of every host that is not null; the prior is found at once.

    The prior is the beta distribution with the mean and the between-host variance of the hosts' rates (method of
    moments, sampling variance taken off). Hosts alike in rate give a strong prior; one host or none, or a variance
    beyond what a beta can have, give a prior worth one document.
    """
    hosts = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    # one row of sums over hosts
    total = hosts.agg(F.sum("n").alias("n_all"), F.sum("failures").alias("f_all"), F.count("*").alias("k"),
                      F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("weighted_squares"),
                      F.sum(F.col("n") * F.col("n")).alias("n_squares"))
    mean = F.col("f_all") / F.col("n_all")
    within = mean * (1 - mean)
    # weighted between-host variance, sampling variance removed
    spread = F.col("weighted_squares") - F.col("n_all") * mean * mean
    scale = F.col("n_all") - F.col("n_squares") / F.col("n_all")
    between = (spread - (F.col("k") - 1) * within) / F.when(scale > 0, scale)
    least = within / 1e6
    strength = F.when(F.col("k") < 2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(1.0), F.coalesce(within / F.when(F.greatest(between, least) > 0, F.greatest(between, least)) - 1,
                                          F.lit(1.0))))
    # two numbers
    prior = total.select((mean * strength).alias("alpha"), ((1 - mean) * strength).alias("beta")).first()
    alpha, beta = prior.alpha or 0.0, prior.beta or 1.0
    shrunk = (F.col("failures") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.select("host", "n", "failures", shrunk.alias("shrunk_rate"))


def bad_hosts(judged: DataFrame, max_rate: float, min_docs: int) -> DataFrame:
    """_host, _bad (true) of the hosts of judged (_host, base_failed) whose documents all go."""
    rates = host_rates(judged.select("_host", "base_failed"), "_host", "base_failed")
    bad = rates.where((F.col("n") >= min_docs) & (F.col("shrunk_rate") > max_rate)).select(
        F.col("host").alias("_host"), F.lit(True).alias("_bad"))
    return F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad


def judge(docs: DataFrame, host: Column | str = "source", text_column: str = "text", max_rate: float = MAX_HOST_RATE,
          min_docs: int = MIN_HOST_DOCS, folder: str | None = None, **rules) -> DataFrame:
    """docs with the columns of ``base_rules`` and kept.

    A document is kept if it passes the rules itself and its host, when it has ``min_docs`` documents or more, has a
    shrunken failure rate of at most ``max_rate``. A null host has no verdict. Hosts are counted map-side, so a host
    with a third of all rows is a few partial rows; the list of bad hosts alone returns to the documents.

    folder   where the judged documents, without their text, are kept between the two passes; without it the rules
             run twice and the text stays
    """
    key = F.col(host) if isinstance(host, str) else host
    judged = base_rules(docs.withColumn("_host", key), text_column, **rules)
    if folder:
        judged.drop(text_column).write.parquet(folder)
        judged = docs.sparkSession.read.parquet(folder)
    bad = bad_hosts(judged, max_rate, min_docs)
    kept = ~F.col("base_failed") & ~F.coalesce("_bad", F.lit(False))
    return judged.join(bad, "_host", "left").withColumn("kept", kept).drop("_host", "_bad")


def keep_good(docs: DataFrame, host: Column | str = "source", text_column: str = "text", folder: str | None = None,
              max_rate: float = MAX_HOST_RATE, min_docs: int = MIN_HOST_DOCS, **rules) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns; see there for nulls, ties and repeated rows.

    folder   where the documents that pass the rules themselves are written, so that the rules run once; without it
             they run for the hosts' rates and again for the result
    """
    if folder is None:
        return judge(docs, host, text_column, max_rate, min_docs, **rules).where("kept").select(*docs.columns)
    key = F.col(host) if isinstance(host, str) else host
    # own columns are kept in a struct, so that none clashes with those of the rules
    judged = base_rules(docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_host"), F.col(text_column).alias("_text")), "_text", **rules)
    judged.select("_host", "base_failed", F.when(~F.col("base_failed"), F.col("_row")).alias("_row")).write.parquet(folder)
    judged = docs.sparkSession.read.parquet(folder)
    bad = bad_hosts(judged, max_rate, min_docs)
    return judged.where("NOT base_failed").join(bad.select("_host"), "_host", "left_anti").select("_row.*")
