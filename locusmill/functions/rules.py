"""Rule packs: ordered first-match classification, roll-up, fusion of evidence.  Rules are data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RulePack:
    """rules: (label, regex) in order; by_category: fallback labels; excluded categories and a name pattern come before all."""

    rules: tuple[tuple[str, str], ...]
    by_category: dict[str, str] = field(default_factory=dict)
    excluded_categories: tuple[str, ...] = ()
    excluded_names: str | None = None
    excluded: str = "excluded"
    unresolved: str = "unresolved"

    def classify(self, name: Column, category: Column) -> Column:
        """struct<label, method, evidence>: the first rule that fits, then the category, then unresolved."""

        def out(label: str, method: str, evidence: Column) -> Column:
            return F.struct(F.lit(label).alias("label"), F.lit(method).alias("method"), evidence.cast("string").alias("evidence"))

        name, category = F.coalesce(name, F.lit("")), F.coalesce(category, F.lit(""))
        drop = category.isin(*self.excluded_categories) if self.excluded_categories else F.lit(False)
        if self.excluded_names:
            drop = drop | name.rlike(self.excluded_names)
        found = F.when(drop, out(self.excluded, "excluded", category))
        for label, pattern in self.rules:
            found = found.when(name.rlike(pattern), out(label, "name", F.regexp_extract(name, f"({pattern})", 1)))
        for c, label in self.by_category.items():
            found = found.when(category == c, out(label, "category", category))
        return found.otherwise(out(self.unresolved, "unresolved", F.lit("")))


def rolled_up(label: Column, taxonomy: dict[str, tuple[str, str]], unknown: str = "unknown") -> tuple[Column, Column]:
    """(major, mid) of a fine label."""
    major, mid = F.lit(unknown), F.lit(unknown)
    for fine, (a, b) in taxonomy.items():
        major, mid = F.when(label == fine, a).otherwise(major), F.when(label == fine, b).otherwise(mid)
    return major, mid


def fused(evidence: list[tuple[str, Column]], confidence: Column | None = None, least: float = 0.5, unresolved: str = "unresolved") -> Column:
    """struct<label, method>: the first evidence with a label, in the order given.  Too low (or no) confidence overrides all."""

    def out(label: Column, method: str) -> Column:
        return F.struct(label.alias("label"), F.lit(method).alias("method"))

    low = F.coalesce(confidence, F.lit(0.0)) < least if confidence is not None else F.lit(False)
    found = F.when(low, out(F.lit(unresolved), "low_confidence"))
    for method, label in evidence:
        found = found.when(label.isNotNull() & (label != "") & (label != unresolved), out(label, method))
    return found.otherwise(out(F.lit(unresolved), "unresolved"))


def last_wins(rows: DataFrame, key: list[str], ord_col: str) -> DataFrame:
    """One row per key, the last by ord_col."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), ord_col).alias("__r"))
    return best.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def tag_genre(tags: Column, cuisines: dict[str, str], amenities: dict[str, str], shops: dict[str, str]) -> Column:
    """The genre of a tag map: the first known cuisine of a list, else the amenity, else the shop, else ''."""

    def table(d: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map(F.lit(""), F.lit(""))

    words = F.transform(F.split(F.coalesce(tags["cuisine"], F.lit("")), ";"), lambda c: table(cuisines)[F.regexp_replace(F.lower(c), " ", "")])
    return F.coalesce(F.get(F.filter(words, lambda w: w.isNotNull()), 0), table(amenities)[tags["amenity"]], table(shops)[tags["shop"]], F.lit(""))


def line_name(operator: Column, line: Column, aliases: dict[str, str], prefixes: dict[str, str]) -> Column:
    """A public line name: alias, or without leading number and branch suffix, with the operator's prefix."""
    bare = F.regexp_replace(F.regexp_replace(line, r"^\d+号線", ""), r"[（(].*[)）]$|支線$", "")
    out = bare
    for name, prefix in prefixes.items():
        out = F.when(operator == name, F.concat(F.lit(prefix), bare)).otherwise(out)
    for old, new in aliases.items():
        out = F.when(line == old, F.lit(new)).otherwise(out)
    return out


def line_kind(operator: Column, kind: Column, subway_operators: list[str], jr_pattern: str) -> Column:
    return F.when(operator.rlike(jr_pattern), "jr").when(operator.isin(*subway_operators) | (kind == "subway"), "subway").otherwise("private")


def in_taxonomy(hierarchy: Column, basic: Column, top: str, basics: list[str]) -> Column:
    """Whether the list's first level is `top`, or there is no list and the basic category is known.  Null where SQL says null."""
    return (F.get(hierarchy, 0) == top) | (hierarchy.isNull() & basic.isin(*basics))


def in_taxonomy_first(hierarchy: Column, basic: Column, top: str, basics: list[str]) -> Column:
    """The same by the first level alone: a list of null, or an empty one, counts as none; never null."""
    first = F.get(hierarchy, 0)
    return F.coalesce((first == top) | (first.isNull() & basic.isin(*basics)), F.lit(False))


def attributed(attributions: Column, marks: list[str]) -> Column:
    """Whether any attribution contains any mark."""
    return F.coalesce(F.exists(attributions, lambda a: F.coalesce(F.expr("false") if not marks else _any(a, marks), F.lit(False))), F.lit(False))


def _any(text: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | text.contains(m)
    return found


def distinct_field(items: Column, field: str, keep=None) -> Column:
    """Sorted distinct values of a struct's field in a list; keep: a condition on an item."""
    kept = F.filter(items, keep) if keep else items
    return F.array_sort(F.array_distinct(F.transform(kept, lambda s: s[field])))


def station_evidence(name: Column, category: Column, permit: Column, tags: Column, answer: Column, confidence: Column, excluded: str = "excluded", unresolved: str = "unresolved") -> Column:
    """struct<label, method>: name, category, permit name, map tags, then an answer of high or middle confidence.  An answer that says excluded counts
    whatever its confidence; an unresolved or low one does not."""
    sure = F.when(answer == excluded, answer).when(confidence.isin("high", "mid") & (answer != unresolved), answer)
    return fused([("name", name), ("category", category), ("permit", permit), ("tags", tags), ("answer", sure)], unresolved=unresolved)


def permit_name(name: Column) -> Column:
    """A permit holder's name without its legal form."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "株式会社|有限会社", ""))


def keep_uncertain(uncertain: Column, label: Column, method: Column, trusted: tuple[str, ...] = ("name", "permit", "tags", "answer"), excluded: str = "excluded") -> Column:
    """The label of an uncertain record only if its method is trusted, else excluded."""
    return F.when(uncertain & ~method.isin(*trusted), excluded).otherwise(label)


def area_evidence(rule: Column, rule_method: Column, answer: Column, confidence: Column, score: Column, least: float = 0.5, unresolved: str = "unresolved") -> Column:
    """struct<label, method, low>: too low a score first, then rules, then an answer; one of low confidence goes to `low` only."""
    weak = F.coalesce(score, F.lit(0.0)) < least
    ruled = rule.isNotNull() & (rule != unresolved)
    said = answer.isNotNull() & (answer != unresolved)
    taken = said & (confidence != "low")
    label = F.when(weak, unresolved).when(ruled, rule).when(taken, answer).otherwise(unresolved)
    method = F.when(weak, "low_confidence").when(ruled, rule_method).when(taken, "answer").otherwise("unresolved")
    low = F.when(~weak & ~ruled & said & (confidence == "low"), answer).otherwise("")
    return F.struct(label.alias("label"), method.alias("method"), low.alias("low"))


def rolled_up_with_fallback(label: Column, category: Column, low: Column, taxonomy: dict[str, tuple[str, str]], categories: dict[str, str], unknown: str = "unknown") -> tuple[Column, Column]:
    """(major, mid): the label's, else the category's major, else the major of a low-confidence label; mid only from the label."""
    major, mid = rolled_up(label, taxonomy, unknown)
    by_category = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])[category]
    low_major = rolled_up(low, taxonomy, unknown)[0]
    return F.when(major != unknown, major).otherwise(F.coalesce(by_category, low_major)), mid


def census_code(major: Column, mid: Column, codes: dict[str, str], retail: tuple[str, ...], specialty: str, default: str, unknown: str = "unknown") -> Column:
    """A census code: by mid, retail for its set, a default for the other mids of the specialty major, else unknown."""
    by_mid = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[mid]
    return F.when(mid.isin(*retail), "retail").otherwise(F.coalesce(by_mid, F.when((major == specialty) & (mid != unknown), default), F.lit(unknown)))


def narrative(ratio: Column, density: Column, quotient: Column) -> Column:
    """A word for a place by thresholds, the first that holds."""
    return F.when(ratio >= 2, "office").when(ratio <= 0.5, "residential").when(density >= 100, "dense").when(quotient >= 1.5, "special").otherwise("mixed")


def first_two(names: Column, mark: str = "・", more: str = "など") -> Column:
    """At most two names, and a word for more."""
    return F.concat(F.array_join(F.slice(names, 1, 2), mark), F.when(F.size(names) > 2, more).otherwise(""))
