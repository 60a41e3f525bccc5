"""Secret scans with a randomness test battery, in DataFrame functions only.

Fixed rules find assignments, access keys and long hexadecimal runs.  Besides, every run of 16 or more base64 characters with a
digit or a lower-upper change is a candidate.  Its encoding is inferred from its characters (hexadecimal, base32, base64); it must look
uniform over that alphabet in three tests: chi-squared of the symbol counts, runs above and below the alphabet's middle, serial
correlation of neighbours (normal approximations, Bonferroni).  Short words pass such tests too easily, hence the false-discovery control:
a candidate's evidence is the likelihood ratio of the uniform alphabet to ordinary writing, whose letter frequencies come from the letter-only
runs of the whole corpus.  Such a ratio is an e-value.  Per doubling of length, the e-Benjamini-Hochberg rule over all candidates
of the corpus sets the least evidence, so the expected share of ordinary strings among the finds of each length class is at most FDR.

Offsets are code points, the end exclusive.  A null text is empty; a null id is kept; equal rows give equal spans; an empty table gives no
rows; other columns are ignored (kept by redact())."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
_C = "A-Za-z0-9+/_-"
#: A whole run of base64 characters, 16 or more, with a digit or a lower-upper change.
CANDIDATE = rf"(?<![{_C}])(?=[{_C}]*(?:[0-9]|[a-z][A-Z]))[{_C}]{{16,}}+"
#: Ordinary writing: whole runs of 16 or more letters.
ORDINARY = rf"(?<![{_C}])[A-Za-z]{{16,}}+(?![{_C}])"

FDR = 0.01
#: The least probability, of the three tests together, at which a candidate still counts as uniform.
UNIFORM = 1e-4
#: Ordinary mixed writing: shares of lower case, upper case, digits and signs; and writing in capitals: capitals, digits, signs.
MIXED, CAPITALS = (0.8, 0.1, 0.08, 0.02), (0.88, 0.1, 0.02)
MOST_BITS = 4000
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"

_SPANS = "array<struct<start: int, kind: int, end: int, token: string>>"
#: Values that one step of a running sum or maximum handles: it copies an array as long for each value.
STEP = 256
#: Code points of a block of text, from which pieces are cut.
TEXT_BLOCK = 512


def _let(value: Column, use) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, join) -> Column:
    """Running sums or maxima of an array of integers from 0 on, join being the operation.  In blocks, so the work grows with the length, not its square."""
    zero = F.lit(0)

    def scan(block: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))

        def add(a: Column, x: Column) -> Column:
            new = join(a["at"], x)
            return F.struct(new.alias("at"), F.concat(a["out"], F.array(new)).alias("out"))

        return F.aggregate(block, start, add, lambda a: a["out"])

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(zero, F.floor((F.size(v) - 1) / STEP).cast("int")), lambda k: scan(F.slice(v, k * STEP + 1, F.lit(STEP))))

        def shifted(local: Column) -> Column:
            before = F.concat(F.array(zero), scan(F.transform(local, lambda x: F.element_at(x, -1))))
            return F.flatten(F.zip_with(local, F.slice(before, F.lit(1), F.size(local)), lambda x, o: F.transform(x, lambda y: join(y, o))))

        return _let(blocks, shifted)

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _find(text: Column, pattern: str, kind: int, least: int | None = None, token: bool = False) -> Column:
    """Leftmost matches, one after the other, with their places.  least: the least length of the pattern's second group.

    Spark has no function for the places of matches, but each match with the text before it is one (longer) match, and
    running sums of their lengths are the matches' ends.  \\G makes it fail at once behind the last match."""
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps = F.transform(F.regexp_extract_all(text, whole, F.lit(1)), F.length)
    values = F.transform(F.regexp_extract_all(text, whole, F.lit(4)), F.length) if least else F.array().cast("array<int>")

    def spans(tokens: Column) -> Column:
        ends = _running(F.zip_with(gaps, tokens, lambda g, t: g + F.length(t)), _sum)
        zipped = F.arrays_zip(ends.alias("end"), tokens.alias("token"), values.alias("value"))
        if least:
            zipped = F.filter(zipped, lambda x: x["value"] >= least)
        return F.transform(zipped, lambda x: F.struct((x["end"] - F.length(x["token"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), (x["token"] if token else F.lit(None).cast("string")).alias("token")))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, whole, F.lit(2)), spans)).otherwise(F.array().cast(_SPANS))


def _count(s: Column, c: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, c, F.lit("")))


def scanned(text: Column) -> Column:
    """base spans, candidates with their strings, and the letter counts of ordinary runs (null without any)."""
    base = F.concat(_find(text, ASSIGN, 0, least=8), _find(text, ACCESS, 1), _find(text, HEX, 2))
    base = F.transform(base, lambda x: F.struct(x["start"], x["kind"], x["end"]))  # which sorts as the digest wants it
    words = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0)), ""))
    return F.struct(F.array_sort(base).alias("base"), _find(text, CANDIDATE, 3, token=True).alias("candidates"), words.alias("words"))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _chosen(kind: Column, values: dict[str, Column]) -> Column:
    out = F.when(kind == "hex", values["hex"]).when(kind == "base32", values["base32"])
    return out.when(kind == "base64", values["base64"])


def _encoded(x: Column) -> Column:
    """The candidate with its encoding; null for decimal digits, which are numbers rather than keys."""
    t = x["token"]
    kind = (
        F.when(t.rlike("^[0-9]+$"), F.lit(None).cast("string"))
        .when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(t.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )
    return F.struct(x["start"], x["end"], t.alias("token"), kind.alias("kind"))


def _costs(letters: list[float], alphabet: str, capitals: bool) -> Column:
    """Bits of each symbol of the alphabet in ordinary writing."""
    out = []
    for c in alphabet:
        if c.isalpha():
            f = letters[LETTERS.index(c.lower())]
            p = (CAPITALS[0] * f if c.isupper() else 1e-6) if capitals else MIXED[1 if c.isupper() else 0] * f
        elif c.isdigit():
            p = (CAPITALS[1] if capitals else MIXED[2]) / 10
        else:
            p = (CAPITALS[2] if capitals else MIXED[3]) / 2
        out.append(-math.log2(p))
    return F.array(*[F.lit(b) for b in out])


def _counted(letters: list[float]):
    """The candidate's symbols over its alphabet: their counts, their sides of the alphabet's middle and their places in it."""

    def count(x: Column) -> Column:
        kind = x["kind"]
        s = _chosen(kind, {"hex": F.lower(x["token"]), "base32": x["token"], "base64": F.translate(x["token"], "-_", "+/")})
        alphabet = _chosen(kind, {k: F.lit(a) for k, a in ALPHABETS.items()})
        half = _chosen(kind, {k: F.lit("L" * (len(a) // 2) + "H" * (len(a) // 2)) for k, a in ALPHABETS.items()})
        tables = [_chosen(kind, {k: _costs(letters, a, capital) for k, a in ALPHABETS.items()}) for capital in (False, True)]
        return F.struct(
            x["start"],
            x["end"],
            F.transform(F.split(alphabet, ""), lambda c: _count(s, c)).alias("counts"),
            F.call_function("translate", s, alphabet, half).alias("sides"),
            F.transform(F.split(s, ""), lambda c: F.call_function("instr", alphabet, c).cast("double")).alias("places"),
            tables[0].alias("mixed"),
            tables[1].alias("capitals"),
        )

    return count


def _sums(x: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("last", "sum", "cross")])
    total = F.aggregate(x["places"], zero, lambda a, v: F.struct(v.alias("last"), (a["sum"] + v).alias("sum"), (a["cross"] + a["last"] * v).alias("cross")))

    def bits(table: Column) -> Column:
        return F.aggregate(F.zip_with(x["counts"], table, lambda n, b: n * b), F.lit(0.0), lambda a, b: a + b)

    return F.struct(
        x["start"],
        x["end"],
        (x["end"] - x["start"]).cast("double").alias("n"),
        F.size(x["counts"]).cast("double").alias("m"),
        F.aggregate(x["counts"], F.lit(0.0), lambda a, n: a + n * n).alias("squares"),
        _count(x["sides"], F.lit("H")).cast("double").alias("high"),
        ((_count(x["sides"], F.lit("LH")) + _count(x["sides"], F.lit("HL"))) / 2).alias("switches"),
        total.alias("t"),
        F.element_at(x["places"], 1).alias("first"),
        F.least(bits(x["mixed"]), bits(x["capitals"])).alias("ordinary"),
    )


def _tested(x: Column) -> Column:
    """The battery: place, length class, bits of evidence, and whether the string looks uniform."""
    n, m, t = x["n"], x["m"], x["t"]
    chi = (x["squares"] * m / n - n - (m - 1)) / F.sqrt(2.0 * (m - 1) * (n - 1) / n)
    mean = 2 * x["high"] * (n - x["high"]) / n
    runs = (x["switches"] - mean) / F.sqrt(F.greatest(mean * (mean - 1) / (n - 1), F.lit(0.05)))
    centre = (m + 1) / 2.0  # mean and variance of a uniform place are known
    together = t["cross"] - centre * (2 * t["sum"] - x["first"] - t["last"]) + (n - 1) * centre * centre
    serial = together / ((m * m - 1) / 12.0) / F.sqrt(n - 1)
    p = 3 * F.least(_tail(chi), 2 * _tail(F.abs(runs)), 2 * _tail(F.abs(serial)))
    bits = F.floor(x["ordinary"] - n * F.log2(m))
    return F.struct(
        x["start"],
        x["end"],
        F.floor(F.log2(n)).cast("int").alias("stratum"),
        F.least(F.greatest(bits, F.lit(-1)), F.lit(MOST_BITS)).cast("int").alias("bits"),
        (p >= UNIFORM).alias("uniform"),
    )


def judged(candidates: Column, letters: list[float]) -> Column:
    """Candidates -> place, length class, bits, uniform, in steps so that each is evaluated once."""
    known = F.filter(F.transform(candidates, _encoded), lambda x: x["kind"].isNotNull())
    return F.transform(F.transform(F.transform(known, _counted(letters)), _sums), _tested)


def _thresholds(bits: DataFrame) -> dict[int, int]:
    """stratum -> the least evidence, by e-Benjamini-Hochberg.  bits: (stratum, bits, n), the histogram of candidates: at most
    31 strata by MOST_BITS bins, however many candidates there are."""
    table: dict[int, list[tuple[int, int]]] = {}
    for r in bits.collect():
        table.setdefault(r["stratum"], []).append((r["bits"], r["n"]))
    found = {}
    for stratum, bins in table.items():
        total, k = sum(n for _, n in bins), 0
        for b, n in sorted(bins, reverse=True):
            k += n
            if b >= 0 and b >= math.log2(total) - math.log2(k) - math.log2(FDR):
                found[stratum] = b
    return found


def letter_shares(words: DataFrame) -> list[float]:
    """Letter frequencies of all ordinary runs (a column `words`), each letter once more than counted."""
    sums = words.where(F.length("words") > 0).agg(*[F.sum(_count(F.col("words"), F.lit(c))).alias(c) for c in LETTERS]).first()
    counts = [1 + (sums[c] or 0) for c in LETTERS]
    return [c / sum(counts) for c in counts]


def _known(base: Column, held: Column) -> Column:
    """All spans, sorted: the base ones, and the random strings (start, kind, end) that do not lie within one of them."""

    def kept(spans: Column) -> Column:
        reach = _running(F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.greatest)
        return F.transform(F.filter(F.arrays_zip(spans.alias("x"), reach.alias("reach")), lambda z: (z["x"]["kind"] < 3) | (z["x"]["end"] > z["reach"])), lambda z: z["x"])

    return _let(F.array_sort(F.concat(base, held)), kept)


class Scan:
    """What the whole corpus says: letter shares and the least evidence of each length class.  rows: the columns of `keep` with the base spans and
    candidates of each text, written, so each text is searched once."""

    def __init__(self, docs: DataFrame, scratch: Scratch, *keep: Column):
        rows = docs.select(*keep, scanned(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("s"))
        self.rows = scratch.table(rows, "scanned")
        self.letters = letter_shares(self.rows.select("s.words"))
        found = self.rows.where(F.size("s.candidates") > 0).select(F.explode(judged(F.col("s.candidates"), self.letters)).alias("c")).select("c.*")
        self.least = _thresholds(found.groupBy("stratum", "bits").agg(F.count("*").alias("n")))

    def spans(self) -> Column:
        """All spans of a row, sorted."""
        base, candidates = F.col("s.base"), F.col("s.candidates")
        least = F.create_map(*[F.lit(x) for kv in (self.least or {-1: 0}).items() for x in kv])
        held = F.filter(judged(candidates, self.letters), lambda c: c["uniform"] & (c["bits"] >= F.coalesce(F.element_at(least, c["stratum"]), F.lit(MOST_BITS + 1))))
        held = F.transform(held, lambda c: F.struct(c["start"], F.lit(3).alias("kind"), c["end"]))
        return F.when(F.size(candidates) > 0, _known(base, held)).otherwise(base)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def find(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and spans (start, kind, end) of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    scan = Scan(docs, scratch, F.col("doc_id").cast("long").alias("doc_id"))
    return scratch.table(scan.rows.select("doc_id", scan.spans().alias("spans")), "spans")


def _cut(blocks: Column, a: Column, z: Column) -> Column:
    """The code points from a to z of a text in blocks; the work is that of the piece and two blocks."""
    i, j = F.floor(a / TEXT_BLOCK).cast("int"), F.floor(z / TEXT_BLOCK).cast("int")
    first = F.coalesce(F.get(blocks, i), F.lit(""))
    last = F.coalesce(F.get(blocks, j), F.lit(""))
    far = F.concat(F.substr(first, a % TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(last, F.lit(1), z % TEXT_BLOCK))
    return F.when(a >= z, "").when(i == j, F.substr(first, a % TEXT_BLOCK + 1, z - a)).otherwise(far)


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    def pieces(blocks: Column, ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), ends)
        each = F.zip_with(spans, F.slice(before, F.lit(1), F.size(ends)), lambda x, at: F.when(x["start"] >= at, F.concat(_cut(blocks, at, x["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(each, ""), _cut(blocks, F.element_at(ends, -1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return _let(blocks, lambda b: _let(_running(F.transform(spans, lambda x: x["end"]), F.greatest), lambda ends: pieces(b, ends)))


def redact(docs: DataFrame, scratch: Scratch | None = None, mark: str = "[secret]") -> DataFrame:
    """docs, all columns, with every span of text replaced by `mark`; overlapping spans give one mark.  n_chars follows."""
    scan = Scan(docs, scratch or Scratch(docs.sparkSession, "secrets"), F.struct("*").alias("row"))
    rows = scan.rows.select("row", scan.spans().alias("spans"))
    hit = F.size("spans") > 0
    text = F.col("row.text").cast("string")
    rows = rows.select("row", hit.alias("hit"), F.when(hit, _redacted(text, F.col("spans"), mark)).otherwise(text).alias("new"))
    out = []
    for name in docs.columns:
        old = F.col("row")[name]
        if name == "text":
            out.append(F.col("new").alias(name))
        elif name == "n_chars":
            out.append(F.when(F.col("hit"), F.length("new").cast(docs.schema[name].dataType)).otherwise(old).alias(name))
        else:
            out.append(old.alias(name))
    return rows.select(*out)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = find(docs)

    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [of(k) for k in range(len(KINDS))]
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return rows.select("doc_id", *counts[:3], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), counts[3])
