"""URL filters: rules by host and path; else segmented host names and path tokens, scored by multinomial naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

#: Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that speak for an unwanted host. They are no verdict: they label the other words of the hosts that hold them, and lend the class ``block`` a prior.
SEEDS = "adult ads bets casino escort lottery pills poker porn sex slots spam torrent tracker viagra warez xxx".split()
#: Share of all counted words that a seed word has besides those found, in the unigram model; count that it has in class ``block`` to begin with.
SEED_SHARE, SEED_PRIOR = 1e-4, 50.0
#: Letters of a host's label at most, by the rules of host names; longer words of texts are in no label.
LABEL = 63
#: Second-level labels that belong to a suffix of a country.
SECOND = "ac co com edu gov net org".split()


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path then up to ? # or the end."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or one of its parents and begins the path; null if none does."""
    out = F.lit(None)
    for name, begin, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        out = F.when(fits, F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def names_of(host: Column) -> Column:
    """The letter runs of a host without its suffix (the last label; of a country's also a second one like ``co``)."""
    return F.regexp_extract_all(F.regexp_replace(host, r"\.(?:(?:%s)\.[a-z]{2}|[^.]*)(?::\d*)?\.?$" % "|".join(SECOND), ""), F.lit(r"(\p{L}+)"), F.lit(1))


def path_tokens(path: Column) -> Column:
    return F.regexp_extract_all(F.lower(path), F.lit(r"(\p{L}+)"), F.lit(1))


def visible_words(html: Column) -> Column:
    """Lower-case letter runs of the text outside tags, comments, scripts and styles."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def unigrams(pages: DataFrame, seeds=SEEDS) -> DataFrame:
    """(word, n): words of all pages' visible texts that a host's label has room for; seed words have SEED_SHARE of all counts more."""
    found = pages.select(F.explode(visible_words(F.col("html"))).alias("word")).where(F.length("word") <= LABEL).groupBy("word").agg(F.count("*").alias("n"))
    found = cut(found, "unigrams")
    more = float(found.agg(F.sum("n")).first()[0] or 0) * SEED_SHARE + 1
    known = found.sparkSession.createDataFrame([(w, more) for w in seeds], "word string, n double")
    return found.select("word", F.col("n").cast("double")).union(known).groupBy("word").agg(F.sum("n").alias("n"))


def best_split(name: str, spans: list[tuple[int, int, float]], log_total: float) -> list[str]:
    """The most probable words of name, by Viterbi: spans are (begin, end, count) of its known parts.

    A known word costs log(total / count); any other stretch of k letters costs log(total) + (k - 1) log(10), so that known words win.
    Equal costs: the longer last word.
    """
    n = len(name)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for begin, end, count in spans:
        ends[end].append((begin, log_total - math.log(count)))
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    unknown, since = math.inf, 0  # cheapest unknown stretch that ends here, and where it begins
    for end in range(1, n + 1):
        if best[end - 1] + log_total < unknown + math.log(10.0):
            unknown, since = best[end - 1] + log_total, end - 1
        else:
            unknown += math.log(10.0)
        best[end], back[end] = min([(unknown, since), *((best[b] + cost, b) for b, cost in ends[end])])
    out, end = [], n
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words): the most probable split of each distinct name under the unigram model.

    The stretches of a name up to LABEL letters are joined to the counts; the known ones come together again by name for best_split.
    """
    log_total = math.log(max(2.0, counts.agg(F.sum("n")).first()[0] or 0))
    ends = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("end"))
    spans = ends.select("name", "end", F.explode(F.sequence(F.greatest(F.lit(1), F.col("end") - LABEL + 1), F.col("end"))).alias("begin"))
    spans = spans.withColumn("word", F.substring(F.col("name"), F.col("begin"), F.col("end") - F.col("begin") + 1))
    known = spans.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct((F.col("begin") - 1).alias("begin"), "end", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            split = [best_split(name, [(s["begin"], s["end"], s["n"]) for s in spans or ()], log_total) for name, spans in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], ["name", "words"])

    return names.join(known, "name", "left").select("name", "spans").mapInArrow(run, "name string, words array<string>")


def token_odds(hosts: DataFrame, shapes: DataFrame, seeds=SEEDS) -> tuple[DataFrame, float]:
    """((token, odds), prior odds) of naive Bayes: log odds of class ``block`` against ``allow``.

    hosts: host, words, pages; shapes: host, shape (its path tokens), pages. A host's word is labelled by the host's *other* words, block if a seed is among them, and not
    at all if the word is the only seed; so no word labels itself. Path tokens are labelled by the host's words. Add-one smoothing; a seed has SEED_PRIOR instead of one in block.
    """
    seed = F.array(*map(F.lit, seeds))
    others = lambda w: F.arrays_overlap(F.array_remove(F.col("set"), w), seed)
    word = hosts.select(F.array_distinct("words").alias("set"), "words", "pages").select("set", F.explode("words").alias("token"), "pages").withColumn("bad", others(F.col("token")))
    word = word.where(F.col("bad") | ~F.array_contains(seed, F.col("token"))).select("token", "bad", "pages")
    bad = hosts.select("host", F.arrays_overlap("words", seed).alias("bad"))
    path = shapes.join(bad, "host").select(F.explode(F.split("shape", " ")).alias("token"), "bad", "pages").where("token <> ''")
    known = hosts.sparkSession.createDataFrame([(w,) for w in seeds], "token string").select("token", F.lit(None).cast("boolean").alias("bad"), F.lit(0).cast("long").alias("pages"))
    sums = word.union(path).union(known).groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0)).alias("b"), F.sum(F.when(~F.col("bad"), F.col("pages")).otherwise(0)).alias("a"))
    sums = cut(sums, "tokens")
    row = sums.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    b, a, v = (float(row[k] or 0) for k in ("b", "a", "v"))
    prior_count = F.when(F.array_contains(seed, F.col("token")), SEED_PRIOR).otherwise(1.0)
    odds = (F.log(F.col("b") + prior_count) - math.log(b + v + 1)) - (F.log(F.col("a") + 1) - math.log(a + v + 1))
    share = hosts.agg(F.sum(F.when(F.arrays_overlap("words", seed), F.col("pages"))).alias("b"), F.sum("pages").alias("all")).first()
    prior = math.log((share["b"] or 0) + 1) - math.log((share["all"] or 0) - (share["b"] or 0) + 1)
    return sums.select("token", odds.alias("odds")), prior


def judge_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, learn_from: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (log odds of block; null where a rule decides), words (the host's) of every url.

    Hosts' names are split into words once per distinct name, by unigrams of all pages' visible texts. Naive Bayes learns from ``learn_from`` (page_id, url; all pages
    if not given): see token_odds. Its tokens are the hosts' words and the paths' tokens that are letters. A url is blocked when the log odds are above 0.
    A null url or one without :// has an empty host and path, no tokens, and is allowed; rows that repeat are judged each; an empty table gives no
    rows; columns of pages other than page_id, url and html are left aside, a null html has no words.
    """
    prepare(pages.sparkSession)
    shape = lambda path: F.concat_ws(" ", path_tokens(path))

    def seen(df: DataFrame) -> DataFrame:
        host, path = parts(F.col("url"))
        return df.select(host.alias("host"), path.alias("path")).select("host", shape(F.col("path")).alias("shape")).groupBy("host", "shape").agg(F.count("*").alias("pages"))

    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    every = cut(seen(pages), "host_shapes")  # few against pages: numbers are left out of shapes
    named = every.select("host").distinct().select("host", F.posexplode(names_of(F.col("host"))).alias("at", "name"))
    words = cut(segment(named.select("name").distinct(), unigrams(pages, seeds)), "segments")
    split = named.join(words, "name").groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    split = cut(split, "words")
    shapes = every if learn_from is None else cut(seen(learn_from), "host_shapes")
    hosts = shapes.groupBy("host").agg(F.sum("pages").alias("pages")).join(split, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    odds, prior = token_odds(hosts, shapes, seeds)

    host_odds = split.select("host", F.explode("words").alias("token")).join(odds, "token").groupBy("host").agg(F.sum("odds").alias("host_odds"))
    shape_odds = every.select("shape").distinct().select("shape", F.explode(F.split("shape", " ")).alias("token")).join(odds, "token").groupBy("shape").agg(F.sum("odds").alias("path_odds"))
    shape_odds = cut(shape_odds, "shapes")  # else the join keeps the aggregation's partitions, and AQE can't split a frequent shape
    about = cut(split.select("host", "words").join(host_odds, "host", "left"), "about_hosts")
    out = rows.withColumn("shape", shape(F.col("path"))).join(about, "host", "left").join(shape_odds, "shape", "left")
    score = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    fit = matching_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("fit", fit).withColumn("block_score", F.when(F.col("fit").isNull(), score))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("block_score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "block_score", "words")
