"""URL filter: glob rules run as one bit-parallel Shift-And automaton over canonical URLs.

Every rule is a glob over the canonical text ``.host/path``: ``*`` stands for any run of bytes
without ``/``, ``**`` for any run at all, ``?`` for one byte other than ``/``. All rules share one
bit vector of as many 64-bit words as they need; each input byte moves every rule at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table, unused

_LOWER = {c: c + 32 for c in range(65, 91)}
RESULT = "struct<host:string,path:string,rule:string,verdict:string>"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs whose canonical text fits ``glob``; ``name`` is reported, the longest name wins."""

    verdict: str
    name: str
    glob: str


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, _, path = rule.partition("/")
    return Rule(verdict, rule, f"*.{host}/{path}**")


class Automaton:
    """Masks of the rules: ``step[byte]`` keeps states that the byte enters, ``stay[byte]`` those it loops in."""

    def __init__(self, rules: Sequence[Rule]):
        step, stay = [[0] * 256, [0] * 256]
        start, self.final, at = 0, [], 0
        for rule in rules:
            start |= 1 << at
            state, glob, i = at, rule.glob.encode(), 0
            while i < len(glob):
                if glob[i : i + 1] == b"*":
                    wide = glob[i : i + 2] == b"**"
                    for c in range(256):
                        if wide or c != 0x2F:
                            stay[c] |= 1 << state
                    i += 2 if wide else 1
                    continue
                state += 1
                for c in [c for c in range(256) if c != 0x2F] if glob[i : i + 1] == b"?" else [glob[i]]:
                    step[c] |= 1 << state
                i += 1
            self.final.append(state)
            at = state + 1
        self.words = max(1, -(-at // 64))
        split = lambda mask: [(mask >> (64 * w)) & (2**64 - 1) for w in range(self.words)]
        self.start = np.array(split(start), np.uint64)
        self.step, self.stay = (np.array([split(m) for m in masks], np.uint64) for masks in (step, stay))

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A boolean for each text and rule: the rule fits the whole text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        offset = (np.cumsum(lengths) - lengths)[order]
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        by_length = -lengths[order]
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(by_length, -t, side="left"))  # texts longer than t
            now, byte = state[:n], data[offset[:n] + t]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.zeros((len(texts), len(self.final)), bool)
        for r, bit in enumerate(self.final):
            out[order, r] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a URL; both empty where it is null or has no ``://``."""
    _, scheme, rest = (url or "").partition("://")
    if not scheme:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    at = min(ends, default=len(rest))
    host, rest = rest[:at].translate(_LOWER), rest[at:]
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    return host, rest[: min(ends, default=len(rest))]


def judge(url: Column, rules: Sequence[Rule], default: str = "allow") -> Column:
    """A struct (host, path, rule, verdict) for a URL column.

    Null, empty and malformed URLs have an empty host and path; where no rule fits, ``rule`` is null
    and ``verdict`` is ``default``. Among rules that fit, the longest name wins, then the first given.
    """
    rules = list(rules)
    automaton = Automaton(rules)
    best = sorted(range(len(rules)), key=lambda r: (-len(rules[r].name), r))

    def call(column: pa.Array) -> pa.Array:
        parts = [split_url(u) for u in column.to_pylist()]
        fits = automaton.matches([f".{h}{p}".encode() for h, p in parts])[:, best]
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if best else np.full(len(parts), -1)
        won = [rules[best[k]] if k >= 0 else None for k in first.tolist()]
        return pa.StructArray.from_arrays(
            [pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], [w and w.name for w in won], [w.verdict if w else default for w in won])],
            ["host", "path", "rule", "verdict"],
        )

    call.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, returnType=RESULT)(url)


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``df`` whose URL is allowed, with all their columns."""
    judged = unused(df, "judged")
    return df.withColumn(judged, judge(F.col(url), rules, default)).filter(F.col(judged)["verdict"] == "allow").drop(judged)


#: The rules that the registered query applies.
RULES = [
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", judge(F.col("url"), RULES).alias("j")).select("page_id", "j.*")


OP9_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
      FROM u JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
