"""Operator 8: URL filtering by rules and by logistic regression on hashed character n-grams.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the longest fitting
rule decides. URLs that no rule fits are judged by a logistic regression over hashed n-grams of host
and path, trained from a small table of labelled URLs (at most MAX_LABELLED rows are used, by a hash
of the url; the model has DIMENSIONS weights). `labelled_urls` makes such a table from topics and
forms of addresses; any table of (url, blocked) can stand in its place.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the
path follows up to `?`, `#` or the end. A null url, or one without `://`, has neither: no rule fits
it, and the model judges it as an empty url. Rows that repeat are judged each on their own, and an
empty table gives no rows. Other columns are carried only if the caller names them; names that the
result has itself (host, path, rule, verdict, spam) cannot be among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .learn import fit_logistic, sigmoid

MAX_LABELLED, DIMENSIONS, SIZES = 2_000, 4096, (3, 4, 5)

# Topics of blocked and of allowed addresses, and forms that both take.
BLOCKED = """casino bets poker pills viagra spam linkfarm adtrack adult xxx cams loans cash prize lottery replica slots
malware crack torrent warez jackpot escort dating pharma cialis clickbait popads keygen phish gambling bonus roulette"""
ALLOWED = """news library garden docs university weather museum wiki science times school council health research
recipes travel music maps forum linux theory station history theatre bakery cycling physics gallery parish archive
there within other thing about between through against where which"""
FORMS = """http://{0}.example.org/en/{1} https://www.{0}.example.com/page/{1} http://{0}-{2}.example.net/{1}.html
https://m.{2}{0}.example.org/de/{1} http://blog.{0}.example.net/ https://{2}.example.org/{0}/{1}
http://www.{0}{2}.example.com/fr/{1}?page=2 https://{0}.{2}.example.net/es/{1}#top"""
FILLERS = "the er on an best my free top tion land net".split()

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The table to train from: url, blocked. Every topic in every form, with fillers in turn."""
    rows = []
    for blocked, topics in ((1, BLOCKED.split()), (0, ALLOWED.split())):
        for i, topic in enumerate(topics):
            for j, form in enumerate(FORMS.split()):
                rows.append((form.format(topic, 17 * i + 101 * j, FILLERS[(i + j) % len(FILLERS)]), blocked))
    return spark.createDataFrame(rows, "url string, blocked int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def match_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add rule (host and path of the longest that fits, else null) and its verdict; urls have host, path.

    Rules are a configuration of the caller and become one CASE expression, longest first, so URLs
    need no shuffle; equal lengths go by the rule's text.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def ngrams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the weights of the n-grams of each host and path, each once: (row, place) by row."""
    lines = [f"^{h}{p}$".encode() for h, p in zip(hosts, paths)]
    data = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    rows, places = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x100000001B3)  # FNV over the bytes
        h ^= h >> np.uint64(29)
        whole = row[: len(h)] == row[n - 1 :]
        rows.append(row[: len(h)][whole])
        places.append((h[whole] % np.uint64(DIMENSIONS)).astype(np.int64))
    both = np.unique(np.concatenate(rows) * DIMENSIONS + np.concatenate(places)) if rows else np.zeros(0, np.int64)
    return both // DIMENSIONS, both % DIMENSIONS


def fit(labelled: DataFrame) -> np.ndarray:
    """Weights, the constant last, from labelled(url, blocked)."""
    host, path = host_and_path(F.col("url"))
    chosen = labelled.where("blocked in (0, 1)").orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED)
    got = chosen.select(host.alias("host"), path.alias("path"), "blocked").collect()
    row, place = ngrams([r.host for r in got], [r.path for r in got])
    seen, column = np.unique(place, return_inverse=True)
    x = np.zeros((len(got), len(seen) + 1))
    x[row, column] = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(got)), 1))[row]
    x[:, -1] = 1
    out = np.zeros(DIMENSIONS + 1)
    w = fit_logistic(x, np.array([r.blocked for r in got], float), l2=0.01)
    out[seen], out[-1] = w[:-1], w[-1]
    return out


def scores(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The model's chance of a block for each host and path."""
    row, place = ngrams(hosts, paths)
    total = np.bincount(row, weights=weights[place], minlength=len(hosts))
    return sigmoid(total / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1)) + weights[-1])


def judge(pages: DataFrame, weights: np.ndarray, rules: list[tuple[str, str, str]], columns: list[str]) -> DataFrame:
    """`columns` of pages with host, path, rule, verdict and the model's chance of a block (spam)."""
    host, path = host_and_path(F.col("url"))
    ruled = match_rules(pages.select(*columns, host.alias("host"), path.alias("path")), rules)
    schema = ruled.drop("rule_verdict").schema.add("verdict", "string").add("spam", "double")

    def run(batches):
        for batch in slices(batches):
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            spam = scores(weights, at["host"].to_pylist(), at["path"].to_pylist())
            verdict = [r or ("block" if s >= 0.5 else "allow") for r, s in zip(at["rule_verdict"].to_pylist(), spam)]
            names = [n for n in at if n != "rule_verdict"]
            yield pa.RecordBatch.from_arrays([*(at[n] for n in names), pa.array(verdict), pa.array(spam)], names=[*names, "verdict", "spam"])

    return ruled.mapInArrow(run, schema)

