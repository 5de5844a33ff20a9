"""URL filters: host word segmentation by unigram Viterbi, then multinomial naive Bayes over host and path tokens.

* The unigram model counts the words (two letters or more, of any length) of the page texts over all pages; a host label
  such as ``freebets`` is split into the words whose product of probabilities is greatest (characters that no word
  covers cost a fixed penalty each).
* The naive Bayes classes come from weak labels: a host with a segmented word of ``SEED_WORDS`` is an example of
  ``block``, every other host of ``allow``.  The seed words of the host that they label are hidden from that example, so the
  model learns the words that keep company with seeds (``farm``, ``win``, ``cheap``) and a host is judged by those.
  Token counts are summed over all pages; the score is the prior log odds of the classes plus those of the tokens.
* Allow and block rules come first; the longest rule that fits decides.

Both models keep every count as a table.  The distinct URLs' stretches of letters, then their tokens, are joined with the counts,
so a task holds only what its own URLs need; a word or token that many URLs have is spread over parts by its count.

Defined cases: a null URL or one without ``://`` has an empty host and path and no token; a URL without a known token is allowed,
its score is the prior; an empty table gives an empty result; repeated rows each get a row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_batches, map_texts

# The rules (host and path) and what each decides.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

# Words of hosts that weakly label an example as unwanted.
SEED_WORDS = frozenset(
    "spam casino bet bets betting poker gambling jackpot slots porn xxx sex adult escort nude pills viagra cialis "
    "pharmacy ads adserver tracker track malware phishing warez crack torrent loan payday".split()
)

SHORTEST = 2  # letters of a word of the unigram model
PIECE = 1000  # letters whose stretches are gathered at once
FLUSH = 100_000  # stretches sent at once
HOT_URLS = 100_000  # a word or token of more URLs is joined in parts
MOST_HOT = 10_000  # so many of them at most: the bound rises with the number of rows
UNKNOWN_COST = 12.0  # natural log units per character that no word covers
_RUN = regex.compile(r"\p{L}+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def rule_for(host: str, path: str, rules: dict[str, str]) -> str | None:
    best = None
    for rule in rules:
        rule_host, slash, rest = rule.partition("/")
        fits = host == rule_host or host.endswith("." + rule_host)
        if fits and path.startswith(slash + rest) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def segment(label: str, cost: dict[str, float], longest: int) -> list[str]:
    """Cheapest split of a run of letters into words (Viterbi over a unigram model); uncovered letters stay together."""
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        choice = (best[end - 1] + UNKNOWN_COST, end - 1)
        for start in range(max(0, end - longest), end):
            c = cost.get(label[start:end])
            if c is not None and best[start] + c < choice[0]:
                choice = (best[start] + c, start)
        best.append(choice[0])
        back.append(choice[1])
    cuts, end = [], len(label)
    while end:
        cuts.append((back[end], end))
        end = back[end]
    words, loose = [], ""
    for a, b in reversed(cuts):
        if label[a:b] in cost:
            words += [loose, label[a:b]] if loose else [label[a:b]]
            loose = ""
        else:
            loose += label[a:b]
    return words + [loose] if loose else words


def host_runs(host: str) -> list[str]:
    return _RUN.findall(".".join(host.split(":")[0].split(".")[:-1]))


def runs_of(host: str, path: str) -> list[str]:
    """The runs of letters that are segmented."""
    return host_runs(host) + _RUN.findall(path.lower())


class Segmenter:
    """Host and path tokens by a unigram model; results are kept for the runs seen last.  ``counts`` needs no more than the
    words that occur in what is segmented, if ``total`` is the sum over all words."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, self.cost), default=1)
        self.run = lru_cache(100_000)(lambda run: segment(run, self.cost, self.longest))

    def host(self, host: str) -> list[str]:
        return [w for run in host_runs(host) for w in self.run(run)] + host.split(":")[0].split(".")[-1:]

    def path(self, path: str) -> list[str]:
        return [w for run in _RUN.findall(path.lower()) for w in self.run(run)]


def page_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(word, n)``: words of two or more letters in the page texts, counted over all pages."""
    text = F.lower(F.regexp_replace(F.col(html_col), r"<[^>]*>", " "))
    return (
        pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
        .filter(F.length("word") >= SHORTEST)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unigrams(words: DataFrame) -> tuple[DataFrame, int]:
    """``(word, n)`` with a least count for the seed words, and the sum of all counts.  ``words``: see ``page_words``."""
    total = words.agg(F.sum("n")).first()[0] or 0
    known = {r.word: r.n for r in words.filter(F.col("word").isin(*SEED_WORDS)).collect()}
    seeds = {w: max(known.get(w, 0), 1 + total // 100_000) for w in sorted(SEED_WORDS)}
    rows = words.sparkSession.createDataFrame(list(seeds.items()), "word string, n long")
    return words.filter(~F.col("word").isin(*SEED_WORDS)).unionByName(rows), total - sum(known.values()) + sum(seeds.values())


def url_key(url: str):
    return F.unhex(F.md5(F.col(url).cast("binary")))


def candidates(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """``(key, word)``: the stretches of letters of each URL that have the length of a word.  ``urls``: key, url."""
    limit_batches(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = [], []
        for batch in batches:
            for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for letters in set(runs_of(*split_url(url))):
                    for size in lengths:
                        if size > len(letters):
                            break
                        for lo in range(0, len(letters) - size + 1, PIECE):
                            found = {letters[a : a + size] for a in range(lo, min(lo + PIECE, len(letters) - size + 1))}
                            words += found
                            keys += [key] * len(found)
                            if len(words) >= FLUSH:
                                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words)], names=["key", "word"])
                                keys, words = [], []
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words)], names=["key", "word"])

    return urls.select("key", "url").mapInArrow(run, "key binary, word string")


def look_up(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """``rows`` (key, ...) joined with ``table`` on ``name``; ``table`` has each name once and, as ``urls``, the rows that
    ask for it.  A name with very many is cut into parts in proportion, so no task gets all of them."""
    total = table.agg(F.sum("urls")).first()[0] or 0
    most = max(HOT_URLS, math.ceil(total / MOST_HOT))
    parts = F.ceil(F.col("urls") / most).cast("int")
    hot = F.broadcast(table.filter(F.col("urls") > most).select(name, parts.alias("parts")))  # at most MOST_HOT rows
    salt = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt")
    salted = rows.join(hot, name, "left").select(*rows.columns, salt)
    return salted.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("urls"), [name, "salt"]).drop("salt")


def url_tokens(urls: DataFrame, pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, n, block, tokens, learned)`` per row of ``urls`` (key, url, n): its tokens by the unigram model of all page words,
    whether a seed word labels its host, and the tokens without the seed words that do."""
    words = scratch.cut(page_words(pages))
    model, total = unigrams(words)
    longest = urls.agg(F.max(F.length("url"))).first()[0] or 0
    sizes = model.select(F.length("word").alias("size")).distinct().filter(F.col("size") <= longest)
    wanted = candidates(urls, sorted(r["size"] for r in sizes.collect()))  # no more sizes than a URL has letters
    needed = scratch.cut(model.join(wanted.groupBy("word").agg(F.count(F.lit(1)).alias("urls")), "word"))
    costs = look_up(wanted, needed, "word").groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("words"))

    def cut(keys, urls, n, words):
        out: dict[str, list] = {"key": keys, "n": n, "block": [], "tokens": [], "learned": []}
        for url, found in zip(urls, words):
            model = Segmenter({w["word"]: w["n"] for w in found or []}, total)
            host, path = split_url(url)
            in_host, in_path = model.host(host) if host else [], model.path(path)
            out["block"].append(not SEED_WORDS.isdisjoint(in_host))
            out["tokens"].append(in_host + in_path)
            out["learned"].append([w for w in in_host if w not in SEED_WORDS] + in_path)
        return out

    rows = urls.join(costs, "key", "left").select("key", "url", "n", "words")
    out = scratch.cut(map_texts(rows, "key binary, n long, block boolean, tokens array<string>, learned array<string>", cut, "url"))
    scratch.drop(words)
    scratch.drop(needed)
    return out


def token_counts(tokens: DataFrame) -> DataFrame:
    """``(token, allow, block, urls)``: how often each token is in URLs weakly labelled so, over all pages; and in how many rows."""
    n = lambda block: F.sum(F.when(F.col("block") == block, F.col("n")).otherwise(0))
    each = tokens.select("n", "block", F.explode("learned").alias("token"))
    return each.groupBy("token").agg(n(False).alias("allow"), n(True).alias("block"), F.count(F.lit(1)).alias("urls"))


def log_odds(allow: int, block: int, all_allow: int, all_block: int, tokens: int) -> float:
    """Multinomial naive Bayes with add-one smoothing: log P(token | block) - log P(token | allow)."""
    return math.log((block + 1) / (all_block + tokens + 1)) - math.log((allow + 1) / (all_allow + tokens + 1))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None
) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, score`` (score: log odds of block, prior included; null if a rule decides)."""
    rules = RULES if rules is None else rules
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    known = rows.filter("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    distinct = scratch.cut(known.select(url_key("url").alias("key"), "url", "n"))
    tokens = url_tokens(distinct, pages, scratch)
    counted = scratch.cut(token_counts(tokens))
    sums = counted.agg(F.sum("allow"), F.sum("block"), F.count(F.lit(1))).first()
    totals = (sums[0] or 0, sums[1] or 0, sums[2])
    classes = {r.block: r.n for r in tokens.groupBy("block").agg(F.sum("n").alias("n")).collect()}
    prior = math.log((classes.get(True, 0) + 1) / (classes.get(False, 0) + 1))
    each = look_up(tokens.select("key", F.explode("tokens").alias("token")), counted, "token")
    # One row of counts per token of the URL; their sum does not depend on the order.
    weighed = scratch.cut(each.groupBy("key").agg(F.collect_list(F.struct("allow", "block")).alias("counts")))

    def judge(ids, urls, counts):
        rows = []
        for page_id, url, found in zip(ids, urls, counts):
            host, path = split_url(url)
            rule = rule_for(host, path, rules)
            score = None
            if rule is None:
                score = math.fsum([prior, *(log_odds(c["allow"], c["block"], *totals) for c in found or [])])
            verdict = rules[rule] if rule else "block" if found and score > 0 else "allow"
            rows.append((page_id, host, path, rule, verdict, score))
        names = ("page_id", "host", "path", "rule", "verdict", "score")
        return {n: [r[k] for r in rows] for k, n in enumerate(names)}

    none = F.concat(F.lit("-"), F.col("page_id").cast("string")).cast("binary")  # rows without a URL do not meet in one task
    rows = rows.withColumn("key", F.coalesce(url_key("url"), none)).join(weighed, "key", "left").select("page_id", "url", "counts")
    return map_texts(rows, "page_id long, host string, path string, rule string, verdict string, score double", judge, "url")
