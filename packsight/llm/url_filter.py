"""URL filtering: host and path rules first, then a logistic regression on hashed character n-grams.

The model is trained on a small table of labelled URLs (a parameter; the default is below).

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule and is
judged by the model on the empty string; very long URLs are read whole; a score of exactly one half
allows; repeated rows are judged each by itself; an empty table gives an empty one; columns of the
result's names are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NGRAMS, BITS = (3, 4, 5), 16

#: The labelled table: blocked hosts with every path, allowed hosts with every allowed path.
BLOCKED_HOSTS = ("ads-server.example", "adtrack.example", "track-pixel.example", "click-banner.example", "popup-ads.example", "casino-bonus.example", "slots-bet.example", "xxx-video.example", "cheap-pills.example", "warez-crack.example", "free-torrent.example", "phish-login.example", "spam-links.example", "doubleads-track.example", "affiliate-click.example", "m.ad-tracker.example.com", "www.banner-ads.example.net", "blog.casino-spins.example.org", "track.clicks.example.com", "ads.popunder.example.net", "win-casino.example.com", "pixel-track.example.org", "m.sponsor-ads.example.com", "bonus-slots.example.net", "www.click-ads.example.org", "free-bet-tips.example.net", "m.best-bets.example.org", "www.pills-online.example.com", "casino.example.org", "cheap-meds.example.com")
BLOCKED_PATHS = ("/", "/banner/728x90", "/track?id=1", "/click/out", "/popup.js", "/casino/win", "/download/crack", "/ads/show", "/pixel.gif")
ALLOWED_HOSTS = ("news.example", "www.library.example", "blog.gardening.example", "docs.software.example", "wiki.history.example", "m.weather.example", "www.university.example", "science.journal.example", "shop.books.example", "www.city-council.example", "forum.cooking.example", "help.support.example", "www.museum.example", "data.statistics.example", "travel.guide.example", "www.northern-station.example.com", "blog.reading.example.org", "m.thinking.example.net", "national.example.com", "another-theatre.example.net", "www.internet-history.example.org", "blog.weathering.example.com", "m.handstand.example.org", "entertainment.example.net", "www.others.example.com")
ALLOWED_PATHS = ("/", "/en/12345", "/de/987.html", "/fr/2024/", "/es/41460", "/articles/how-to-plant", "/2023/05/report", "/index.html", "/about")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, label) rows of the default training table; 1 means block."""
    both = ((BLOCKED_HOSTS, BLOCKED_PATHS + ALLOWED_PATHS, 1), (ALLOWED_HOSTS, ALLOWED_PATHS, 0))
    return [(host, path, label) for hosts, paths, label in both for host in hosts for path in paths]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _ngrams(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all strings, and the string each belongs to."""
    data = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint32)
    lengths = np.array([len(s) for s in strings])
    owner = np.repeat(np.arange(len(strings)), lengths)
    rows, hashes = [], []
    for n in NGRAMS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ data[k : k + count]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        inside = owner[:count] == owner[n - 1 :]
        rows.append(owner[:count][inside])
        hashes.append((h & np.uint32((1 << BITS) - 1))[inside])
    return (np.concatenate(hashes), np.concatenate(rows)) if rows else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _logits(weights: np.ndarray, bias: float, strings: Sequence[bytes]) -> np.ndarray:
    hashes, rows = _ngrams(strings)
    total = np.bincount(rows, weights[hashes], len(strings))
    return total / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(strings)))) + bias


def _string(host: str, path: str) -> bytes:
    return f"^{host}|{path}$".encode()


def train(table: Sequence[tuple[str, str, int]], rounds: int = 1000, rate: float = 4.0, penalty: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent on a small (host, path, label) table.

    Blocked rows weigh a quarter of the total, as most URLs are harmless.
    """
    strings, y = [_string(h, p) for h, p, _ in table], np.array([label for *_, label in table], dtype=float)
    hashes, rows = _ngrams(strings)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(strings))))
    share = np.where(y == 1, 0.25 / max(1, y.sum()), 0.75 / max(1, (1 - y).sum()))
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        z = np.bincount(rows, weights[hashes], len(strings)) * scale + bias
        error = (1 / (1 + np.exp(-z)) - y) * share
        weights -= rate * (np.bincount(hashes, (error * scale)[rows], 1 << BITS) + penalty * weights)
        bias -= rate * 0.1 * error.sum()
    return weights, bias


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does.

    A rule is (verdict, "host/path"). The list is a parameter of bounded size.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer rules wrap shorter ones
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: Sequence[tuple[str, str, int]] | None = None, key: str = "page_id", url: str = "url", threshold: float = 0.6) -> DataFrame:
    """key, host, path, rule, score (probability of block) and verdict of every row."""
    weights, bias = train(labelled if labelled is not None else labelled_urls())
    weights = weights.astype(np.float32)
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    schema = parts.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(utf8(batch.column("host")).to_pylist(), utf8(batch.column("path")).to_pylist())
            z = _logits(weights, bias, [b"^" + h + b"|" + p + b"$" for h, p in both])
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    scored = map_arrow(parts, run, schema)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise("allow")
    return scored.select(key, "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, own).alias("verdict"))
