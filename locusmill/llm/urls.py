"""URL filters: glob rules run as one bit-parallel automaton (Shift-And with wildcards).

A rule is a host and the beginning of a path ("example.com/en/"); it fits its host and all subdomains.  A glob is a pattern over
host and path in which * stands for any run of characters and ? for one.  All become patterns over one canonical string
"." + host + SEP + path, where SEP is a byte that UTF-8 never has, so no pattern slips from host to path.  Every literal or ? is a
bit of a multiword state; a * is a self-loop on the bit before it.  One step per byte moves all patterns of all
URLs of a batch.

A null url, or one without "://", has an empty host and path; then no rule fits, and the globs judge the empty string.  Repeated
rows are judged alike; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

#: (rule, verdict): the fixed rules.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Globs over host and path that block where no rule fits; everything else is allowed.
GLOBS = ("*cheap*pills*/*", "*spam*farm*/*", "*free*bets*/*", "*adult*/*", "*casino*/*", "*/wp-login.php*", "*/*/wp-login.php*", "*.exe")

SEP = 0xFF
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


def split(url: str | None) -> tuple[str, str]:
    m = _HOST.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def canonical(host: str, path: str) -> bytes:
    return b"." + host.encode("utf-8", "surrogatepass") + bytes([SEP]) + path.encode("utf-8", "surrogatepass")


def rule_glob(rule: str) -> bytes:
    host, slash, path = rule.partition("/")
    escaped = (host.translate(_LOWER).encode(), (slash + path).encode())
    return b"*." + escaped[0] + bytes([SEP]) + escaped[1] + b"*"


def url_glob(glob: str) -> list[bytes]:
    """A glob over host and path; its first "/" is the border between them, and without one it may lie in either."""
    host, slash, path = glob.partition("/")
    if slash:
        return [b"." + host.encode() + bytes([SEP]) + b"/" + path.encode()]
    return [b"." + bytes([SEP]).join((host.encode(), b"*")), b".*" + bytes([SEP]) + host.encode()]


class Automaton:
    """All patterns at once.  Bits: for each pattern a start bit, then one per literal or ?.  A * gives the bit before it a loop."""

    def __init__(self, globs: list[bytes]):
        steps: list[tuple[int, int]] = []  # (byte, or -1 for any, or -2 for a start bit; pattern)
        loops: list[int] = []
        self.ends: list[int] = []
        for n, g in enumerate(globs):
            steps.append((-2, n))
            for c in g:
                if c == 0x2A:
                    loops.append(len(steps) - 1)
                else:
                    steps.append((-1 if c == 0x3F else c, n))
            self.ends.append(len(steps) - 1)
        self.words = len(steps) // 64 + 1
        self.by_byte = np.zeros((256, self.words), np.uint64)
        for i, (c, _) in enumerate(steps):
            if c != -2:
                rows = [b for b in range(256) if b != SEP and b & 0xC0 != 0x80] if c == -1 else [c]  # ? takes a character's first byte, never the border
                self.by_byte[rows, i // 64] |= np.uint64(1 << i % 64)
        self.loop, self.start, self.any = (np.zeros(self.words, np.uint64) for _ in range(3))
        for i, (c, _) in enumerate(steps):
            if c == -1:
                self.any[i // 64] |= np.uint64(1 << i % 64)
        for i in loops:
            self.loop[i // 64] |= np.uint64(1 << i % 64)
        for i, (c, _) in enumerate(steps):
            if c == -2:
                self.start[i // 64] |= np.uint64(1 << i % 64)

    def run(self, strings: list[bytes]) -> np.ndarray:
        """[string, pattern]: which patterns fit the whole string."""
        out = np.zeros((len(strings), len(self.ends)), bool)
        sizes = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(strings), np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        state = np.tile(self.start, (len(strings), 1))
        last, one = np.uint64(63), np.uint64(1)
        live = len(order)
        lengths = sizes[order]
        for t in range(int(sizes.max(initial=0))):
            while live and lengths[live - 1] <= t:
                live -= 1
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> last
            c = text[begin[:live] + t]
            # Further bytes of a character stay where ? took its first one.
            state[:live] = (moved & self.by_byte[c]) | (d & self.loop) | (d & np.where((c & 0xC0 == 0x80)[:, None], self.any, np.uint64(0)))
        for n, e in enumerate(self.ends):
            out[order, n] = (state[:, e // 64] >> np.uint64(e % 64) & one).astype(bool)
        return out


def judge(pages: DataFrame, rules=RULES, globs=GLOBS) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict."""
    ship(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches):
        ranked = sorted(rules, key=lambda r: -len(r[0]))
        patterns = [rule_glob(r) for r, _ in ranked]
        extra = [p for g in globs for p in url_glob(g)]
        machine = Automaton(patterns + extra)
        for b in batches:
            ids, urls = b.column(0), b.column(1).to_pylist()
            for lo in range(0, len(urls), 4096):
                both = [split(u) for u in urls[lo : lo + 4096]]
                hit = machine.run([canonical(*x) for x in both])
                by_rule, blocked = hit[:, : len(patterns)], hit[:, len(patterns) :].any(axis=1)
                first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1).tolist()
                rule = [ranked[k][0] if k >= 0 else None for k in first]
                verdict = [ranked[k][1] if k >= 0 else "block" if x else "allow" for k, x in zip(first, blocked.tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 4096), pa.array([h for h, _ in both], pa.string()), pa.array([p for _, p in both], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages)


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM s),
l AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
r(rule, host_end, path_start, word) AS (VALUES ('com/', '.com', '/', 'allow'), ('example.com/en/', '.example.com', '/en/', 'block'),
  ('www.example.com/en/', '.www.example.com', '/en/', 'allow'), ('net/es/', '.net', '/es/', 'block'), ('net/fr/', '.net', '/fr/', 'block')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(word, length(rule)) AS word FROM l, r
  WHERE ends_with('.' || host, host_end) AND starts_with(path, path_start) GROUP BY page_id)
SELECT l.page_id, l.host, l.path, f.rule, coalesce(f.word, CASE
  WHEN path LIKE '/%' AND (host LIKE '%cheap%pills%' OR host LIKE '%spam%farm%' OR host LIKE '%free%bets%' OR host LIKE '%adult%' OR host LIKE '%casino%') THEN 'block'
  WHEN path LIKE '%/wp-login.php%' OR host LIKE '%.exe' OR path LIKE '%.exe' THEN 'block' ELSE 'allow' END) AS verdict
FROM l LEFT JOIN f USING (page_id)
"""
