"""Secret scans by a trigram inverted index.

Each rule's regex is described by the parts it must contain; from them a Boolean trigram query is derived: any of
several clauses, each the set of all trigrams of one mandatory part. Postings (trigram, document) are kept for the
trigrams of the queries, clauses are intersected on the postings, and only documents that satisfy a rule's query are
verified with its regex. Rules without mandatory trigrams (runs of hexadecimal digits) scan every text.

Defined results: null and empty texts have no spans. Documents are told apart by a hash of all they contain, so
repeated rows are found alike and null ids work. Offsets are code points, ends exclusive. Extra columns stay
inside ``row``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import ROW, packed


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans leftmost first; one whose ``group`` has fewer than ``least`` characters is dropped.

    ``needs``: each match holds one of these strings, letter case aside (empty: nothing is mandatory).
    """

    name: str
    pattern: str
    group: int
    least: int
    needs: tuple[str, ...] = ()


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_KEYWORD = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])

# The three base rules in their listed order, then those this operator adds.
BASE = (
    Rule("assign", rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, KEYWORDS),
    # Runs with their least length in the pattern: a run that is too short holds no longer one, so none is lost.
    Rule("access", "AKIA[A-Z0-9]{14,}", 0, 18, ("akia",)),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z][A-Z ]* )?PRIVATE KEY-----", 0, 1, ("-----begin ",)),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, (".eyj",)),
)
RULES = BASE + ADDED


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Clauses, one of which must hold: all trigrams of a mandatory string in lower case; empty if none are mandatory."""
    clauses = [frozenset(n[i : i + 3] for i in range(len(n) - 2)) for n in map(str.lower, rule.needs)]
    return [] if any(not c for c in clauses) else clauses


def _any_of(trigrams: list[str]) -> str:
    """A pattern that stands before each of the trigrams, overlapping ones too; tried by first character."""
    firsts: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        firsts.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in firsts.items()) + "))"


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key) once for every query trigram that a text contains; ``keyed`` has ``key`` and ``text``."""
    low = F.lower("text")  # A-Z at least become a-z: what it changes besides can only add candidates
    held = F.array_distinct(F.regexp_extract_all(low, F.lit(_any_of(trigrams)), F.lit(1)))
    return keyed.select("key", F.explode(held).alias("trigram"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, mask): bit r is set if the text satisfies the trigram query of rule r. Rules without a query are left out."""
    wanted = [(t, r, f"{r}:{n}", len(c)) for r, rule in enumerate(rules) for n, c in enumerate(trigram_query(rule)) for t in sorted(c)]
    if not wanted:
        return keyed.select("key", F.lit(0).alias("mask")).limit(0)
    # The clauses of the rules: a few dozen rows whatever the input.
    clauses = keyed.sparkSession.createDataFrame(wanted, "trigram string, rule int, clause string, needed int")
    listed = postings(keyed, sorted({w[0] for w in wanted})).distinct()
    met = listed.join(F.broadcast(clauses), "trigram").groupBy("key", "rule", "clause", "needed").agg(F.count("*").alias("held"))
    return met.where("held = needed").groupBy("key").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("mask"))


def _with_spans(rows: DataFrame, rule: Rule, order: int, wanted: Column) -> DataFrame:
    """Adds ``s<order>``: array of (start, kind, end). Matches and the texts between them alternate, so lengths give places."""
    name, text = f"s{order}", F.when(wanted, F.col("text"))
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1))
    gaps = F.split(text, rule.pattern, -1)
    rows = rows.withColumn("found", found)
    some = F.size("found") > 0
    parts = F.zip_with(F.transform("found", lambda m: F.length(m)), F.transform(F.col("value"), lambda v: F.length(v)), lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    rows = rows.withColumn("value", F.when(some, value)).withColumn("gaps", F.when(some, gaps))
    rows = rows.withColumn("parts", F.zip_with(parts, F.transform("gaps", lambda g: F.length(g)), lambda p, g: F.struct(p["m"].alias("m"), p["v"].alias("v"), g.alias("g"))))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    at = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))

    def step(a, p):
        start = a["at"] + p["g"]
        end = start + F.coalesce(p["m"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        kept = F.when(p["v"] >= rule.least, F.concat(a["spans"], one)).otherwise(a["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    folded = F.aggregate("parts", at, step, lambda a: a["spans"])
    return rows.withColumn(name, F.coalesce(folded, nothing)).drop("found", "value", "gaps", "parts")


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` and ``spans``: array of (start, kind, end), by start, then the rule's place in ``rules``."""
    keyed = packed(docs, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    # The same key for the same row, whenever and wherever it is computed; copies of a text under other ids differ.
    keyed = keyed.withColumn("key", F.xxhash64(ROW))
    found = candidates(keyed.select("key", "text"), rules)
    rows = keyed.join(found, "key", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    for order, rule in enumerate(rules):
        wanted = F.col("mask").bitwiseAND(1 << order) > 0 if trigram_query(rule) else F.lit(True)
        rows = _with_spans(rows, rule, order, wanted)
    spans = F.array_sort(F.concat(*[F.col(f"s{order}") for order in range(len(rules))]))
    return rows.select(ROW, "text", spans.alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans replaced by ``mark`` (overlapping spans: one mark)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").cast("string").alias("out"))

    def step(a, s):
        between = F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], between).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
