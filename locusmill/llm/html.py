"""HTML extraction by equivalence-class template deduction.

Every page becomes tokens: its tags, told apart by their path, and the strings of its text nodes with their path.
Within a host the occurrence vector of a token says how often each page holds it.  Vectors are compared by a fingerprint, the
exclusive or of hashes of (page, count), which sums up page by page in any order.  Tokens of one host with one fingerprint are an equivalence
class; a class is valid if it holds at least CLASS tokens and covers at least SUPPORT pages and SHARE of the host's pages.  The root class is
the one on most pages; a class is nested in it if its tokens' paths lie within a path of the root's.  Valid nested classes are the host's
template.  Text that is itself a template token is boilerplate, inside an article as elsewhere; what remains are the slots, each
named by its tag path.

A slot is read as content unless its path runs through furniture: navigation, header, footer, aside, form, script, style,
or an element whose class, id or role names nothing but an advert, notice, menu, comments and the like.  Pages with an article (or main)
element keep only the slots in it, or its whole text if the template covers all of it (a copied article); the rest keep all others,
linked or not.

A null html is empty and gives an empty text, a null url one host of its own; a host with few pages has no template and
is read by paths alone.  Repeated rows are pages of their own; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship
from .urls import split

CLASS, SUPPORT, SHARE = 3, 4, 0.5
#: Bytes of all templates up to which they are broadcast; beyond, pages and templates are joined by host.
BROADCAST = 16 << 20

#: Attributes: a name, perhaps "=" and a quoted or unquoted value; a quote has a meaning only right behind "=".  Possessive, so that it never goes back.
_ATTRIBUTES = r"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^\s>]++)?)?|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])|\Z", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math")}
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a run of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("nav header footer aside form script style noscript template iframe svg math button select option textarea input dialog menu head title object canvas".split())
#: Words of class, id or role that mark furniture, where a name is made of nothing but these and PLAIN ones: "main-menu" is, "menu-of-the-day" not.
MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu menubar modal nav navbar navigation newsletter notice notices popup promo promotion promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split())
PLAIN = frozenset("a area b bar block body bottom box button container content desktop fixed float footer foot form global group head holder id inner item items left link links list main mobile outer page panel post posts primary right row secondary section signup site slot space spot sticky top unit wrap wrapper zone articles stories".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@functools.lru_cache(1 << 14)
def _label(name: str, attributes: str) -> tuple[str, bool]:
    """The element's name in a path, and whether it is furniture."""
    marks: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for each in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(_WORDS.findall(each))
            if words & MARKS and words <= MARKS | PLAIN:
                marks |= words & MARKS
    return name + "".join("." + w for w in sorted(marks)), bool(marks) or name in FURNITURE


def nodes(page: str):
    """(kind, path, text, furniture, place) of a page in order: kind "tag" for an opening tag (text is its name), "end" for one
    that ends a block, "text" for a text node.  place: "article", "main" or "".  Unclosed and stray tags are tolerated."""
    stack: list[tuple[str, str, bool, str]] = [("", "", False, "")]  # name, path, furniture, place
    at, n = 0, len(page)
    while at < n:
        stop, m = page.find("<", at), None
        while stop >= 0 and not (m := _TOKEN.match(page, stop)):
            stop = page.find("<", stop + 1)  # a "<" that begins no tag is text
        stop = n if stop < 0 else stop
        if stop > at:
            top = stack[-1]
            yield "text", top[1], page[at:stop], top[2], top[3]
        if not m:
            return
        at = max(m.end(), at + 1)
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                top = stack[-1]
                yield "text", top[1], entities.escape(m[0][9:].removesuffix("]]>")), top[2], top[3]
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            if name not in INLINE:
                yield "end", stack[-1][1], name, False, ""
            continue
        closes = _CLOSES.get(name, set()) | ({"p"} if name in _CLOSE_P else set())
        while closes and len(stack) > 1:
            # An unclosed inline element does not keep its block open.
            k = len(stack) - 1
            while k > 0 and stack[k][0] in INLINE:
                k -= 1
            if stack[k][0] not in closes:
                break
            del stack[k:]
        label, own = _label(name, m[3])
        _, path, furniture, place = stack[-1]
        place = name if name in ("article", "main") and place != "article" else place
        top = (name, f"{path}/{label}", furniture or own, place)
        yield "tag", top[1], name, top[2], top[3]
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            if name in ("title", "textarea") and end.start() > at:
                yield "text", top[1], page[at : end.start()], True, top[3]
            close = page.find(">", end.start())
            at = n if close < 0 else close + 1
            yield "end", path, name, False, ""
        elif name not in VOID and not m[0].endswith("/>"):
            stack.append(top)


@functools.lru_cache(1 << 14)
def _tag_key(path: str) -> tuple[int, str, str]:
    return xxhash.xxh3_64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63), "tag", path


def _text_key(path: str, text: str) -> int:
    """text: a text node as written, without white space around it."""
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def page_tokens(page: str | None) -> Counter:
    """token -> occurrences, a token being (key, kind, path)."""
    tokens = []
    for kind, path, text, _, _ in nodes(page or ""):
        if kind == "tag":
            tokens.append(_tag_key(path))
        elif kind == "text" and (t := text.strip()):
            tokens.append((_text_key(path, t), "text", path))
    return Counter(tokens)


def extract(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text: blocks in page order, joined by one space."""
    blocks: list[tuple[str, str]] = []  # text, place
    run: list[str] = []
    where = ""
    covered = set()  # places with text of the template

    def close() -> None:
        text = _plain("".join(run))
        if text:
            blocks.append((text, where))
        run.clear()

    for kind, path, text, furniture, place in nodes(page or ""):
        if kind == "text":
            if furniture:
                continue
            if place != where:
                close()
                where = place
            if template and _text_key(path, text.strip()) in template:
                covered.add(place)
                continue
            run.append(text)
        elif text not in INLINE or furniture:
            close()
    close()
    for best in ("article", "main"):
        found = [t for t, p in blocks if p == best]
        if found:
            return " ".join(found)
        if best in covered:
            return extract(page)
    return " ".join(t for t, _ in blocks)


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, keys: the template tokens of each host that has one."""
    ship(pages.sparkSession)
    schema = pa.schema([("host", pa.string()), ("uid", pa.int64()), ("key", pa.int64()), ("kind", pa.string()), ("path", pa.string()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            uids, urls, pages = (b.column(i).to_pylist() for i in range(3))
            for lo in range(0, len(urls), 256):
                rows = []
                for uid, url, page in zip(uids[lo : lo + 256], urls[lo : lo + 256], pages[lo : lo + 256]):
                    host = split(url)[0]
                    rows.append((host, uid, 0, "page", "", 1))
                    rows += [(host, uid, key, kind, path, n) for (key, kind, path), n in page_tokens(page).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = rows.mapInArrow(run, "host string, uid long, key long, kind string, path string, n long")
    # Occurrence vectors meet as fingerprints: partial sums, whatever the size of a host.
    vector = F.bit_xor(F.xxhash64("uid", "n"))
    tokens = found.groupBy("host", "key", "kind", "path").agg(F.count("*").alias("pages"), vector.alias("vector")).where((F.col("pages") >= SUPPORT) | (F.col("kind") == "page"))
    tokens = scratch.table(tokens, "tokens")
    hosts = tokens.where(F.col("kind") == "page").select("host", F.col("pages").alias("all"))
    real = tokens.where(F.col("kind") != "page").join(hosts, "host").where(F.col("pages") >= SHARE * F.col("all"))
    groups = real.groupBy("host", "vector", "pages").agg(F.count("*").alias("size"), F.min("path").alias("outer")).where(F.col("size") >= CLASS)
    root = groups.groupBy("host").agg(F.max(F.struct("pages", "size", "outer")).alias("r")).select("host", F.col("r.outer").alias("root"))
    nested = groups.join(root, "host").where(F.col("outer").startswith(F.col("root"))).select("host", "vector", "pages")
    texts = real.where(F.col("kind") == "text").join(nested, ["host", "vector", "pages"], "left_semi")
    return scratch.table(texts.groupBy("host").agg(F.collect_set("key").alias("keys")), "templates")


def main_text(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    found = templates(pages, scratch or Scratch(spark, "html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(known):
        def each(batches):
            for b in batches:
                ids, urls, pages = (b.column(i).to_pylist() for i in range(3))
                keys = b.column(3).to_pylist() if known is None else [known.value.get(split(u)[0]) for u in urls]
                for lo in range(0, len(urls), 256):
                    texts = [extract(p, frozenset(k or ())) for p, k in zip(pages[lo : lo + 256], keys[lo : lo + 256])]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 256], pa.int64()), pa.array(urls[lo : lo + 256], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

        return each

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    size = found.agg(F.sum(F.size("keys") * 8 + F.length("host") + 64)).first()[0] or 0
    out = "page_id long, url string, text string, n_chars long"
    if size <= BROADCAST:
        known = spark.sparkContext.broadcast({r["host"]: frozenset(r["keys"]) for r in found.toLocalIterator()})
        return rows.mapInArrow(run(known), out)
    host = F.coalesce(F.translate(F.regexp_extract("url", r"(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    joined = rows.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "keys")
    return joined.mapInArrow(run(None), out)


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return main_text(pages)
