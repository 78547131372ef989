"""URL filters: a trie over reversed host labels, then path segments.

A rule is (action, host, path) and fits its host and all subdomains, if the url's path starts with the rule's path. Of
the rules that fit, the one with the most characters in host and path decides; of one length, block before allow. The
trie goes to executors by broadcast: judge() takes at most MAX_RULES rules of MAX_CHARS characters in all, and refuses
more. A table of rules of any length is for judge_by_join(), which gives the same by host suffix and no broadcast.

Host: from the first :// up to /, ?, # or the end, A-Z lower-cased, port and user kept. Path: from there up to ?, # or
the end. Null urls and urls without :// have an empty host and path, and no rule fits. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import lower_az, texts
from textloom.session import ship

#: (action, host and path) used in production.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEFAULT_VERDICT = "allow"
#: What judge() broadcasts at most.
MAX_RULES, MAX_CHARS = 200_000, 16 << 20


def parsed(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str, str]]:
    out = []
    for action, text in rules:
        host, slash, path = text.partition("/")
        if action not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {action!r} {text!r}")
        out.append((action, host.lower(), slash + path))
    return out


class UrlTrie:
    """Nodes are dicts by label, then, under PATH, by segment. ENDS holds the rules of a node by the rest of their path."""

    PATH, ENDS = 0, 1

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for action, host, path in parsed(rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATH, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(self.ENDS, {})
            if ends.get(rest, ("allow",))[0] == "allow":
                ends[rest] = (action, host + path, len(host) + len(path))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits."""
        best, segments, node = None, path.split("/"), self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(self.PATH)
            for segment in segments:
                if below is None:
                    break
                for rest, end in below.get(self.ENDS, {}).items():
                    if segment.startswith(rest) and (best is None or (end[2], end[0] == "block") > (best[2], best[0] == "block")):
                        best = end
                below = below.get(segment)
        return best and best[:2]


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_az(host), path


def _split(pages: DataFrame, url_col: str, id_col: str) -> DataFrame:
    host, path = parts(F.col(url_col))
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, url_col: str = "url", id_col: str = "page_id", default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict."""
    rules = list(rules)
    if len(rules) > MAX_RULES or sum(len(t) for _, t in rules) > MAX_CHARS:
        raise ValueError("too many rules to broadcast; judge_by_join() takes them as a table")
    split = _split(pages, url_col, id_col)
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UrlTrie(shared.value)
        for batch in batches:
            found = [trie.match(h, p) or (default, None) for h, p in zip(texts(batch, "host"), texts(batch, "path"))]
            columns = [*batch.columns, pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    kind = split.schema["page_id"].dataType.simpleString()
    return split.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = DEFAULT_VERDICT) -> DataFrame:
    """The same with a table of rules (action, rule): distinct hosts and paths meet the rules by host suffix."""
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substr("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    start = F.when(slash > 0, F.substr(F.col("rule"), slash)).otherwise(F.lit(""))
    table = rules.where("action in ('allow', 'block')").select("action", F.lower(host).alias("on"), start.alias("start")).where("on <> ''")
    split = _split(pages, url_col, id_col)
    labels = F.split("host", r"\.")
    urls = split.select("host", "path").distinct()
    suffixes = urls.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("on"))
    fits = suffixes.join(table, "on").where(F.startswith("path", "start"))
    rank = F.struct(F.length("on") + F.length("start"), (F.col("action") == "block").cast("int"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("on", "start").alias("rule"), "action"), rank).alias("b"))
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))
