"""Operator 3: personal data by candidate gradient boosting, in DataFrame operations alone.

High-recall generators propose spans.  The base generators are fixed rules for
e-mail addresses, IP addresses, card and phone numbers; their spans are always
kept.  The further ones propose loose forms that may overlap base spans and each
other: spelt-out addresses, national phone numbers, card-like and key-like
strings.  Each candidate has binary features of its format (kind, length, digits,
mixed case, check sums, separators) and of its context (words and signs before
and after it).  Boosted trees of depth two over these features score it.

Trees are fitted on ``EXAMPLES`` made-up sentences.  Each has one planted string
that is or is not personal data, known by how it was made and not by its form:
the same hexadecimal digits may be a key or a file's check sum, the same digits
a card or an order number, and either may stand behind a telling word or not.
Trees are fitted on seven tenths of the sentences; on the others each kind
gets the least threshold at which precision reaches ``PRECISION``.  The corpus
is read once, to be searched.

Positions are code points, ends exclusive.  Defined results: a null or empty
text has no spans; an empty table gives no rows; base spans of one kind do not
overlap, those of different kinds and added ones may; an added span that lies in
a base span of any kind is left out; repeated rows are searched each; other
columns are kept, columns named like the results are replaced.  Possessive forms
and left edges keep the search linear in the text, however long, and without
recursion; spans are gathered and compared by scans in blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Base rules, with possessive repeats and left edges that change no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Signs without which a text has no match of a base rule.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Generators of further candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,}+)++",
    "phone": r"\(?\b[0-9]{3}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}\b",
    "card": r"\b[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}\b",
    "secret": r"\b[A-Za-z0-9_/+-]{20,}+(?![A-Za-z0-9_/+-])",
}
LOOSE_NEEDS = {"email": r"[(\[]at[)\]]", "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}", "card": r"[0-9]{4}[\x20-]?[0-9]{4}", "secret": r"[A-Za-z0-9_/+-]{20}"}
#: Words whose presence before a candidate speaks for it.
TELLING = r"(?i)(?:token|secret|passwor[dt]|api[_ -]?key|\bkey|e-?mail|mail|phone|\btel|call|card|visa|iban|account|contact)\W{0,6}$"
FEATURES = ("telling", "quoted", "assigned", "digits", "letters", "mixed_case", "luhn", "hex", "long", "separated", "edge", "both", "cut", "marked", "email", "phone", "card")
TREES, RATE, PRECISION = 24, 0.4, 0.9
CONTEXT = 24
#: Made-up sentences that the classifier is fitted on and calibrated with.
EXAMPLES = 6000
#: Items of a block of a scan.
BLOCK = 64
_SPAN = "struct<t:string,s:int,e:int,b:string,f:string>"


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, step, out, kind: str) -> Column:
    """``out(state, item)`` of each item as an array of ``kind``; the state, a number, starts
    as 0 and has taken ``step(state, item)``.

    Arrays grow by copying, so states are carried over blocks first and items are
    gathered block by block: the work is linear for all but millions of items.
    """

    def gathered(block: Column, at: Column) -> Column:
        first = F.struct(at.alias("a"), F.array().cast(f"array<{kind}>").alias("o"))
        return F.aggregate(block, first, lambda acc, x: F.struct(step(acc["a"], x).alias("a"), F.concat(acc["o"], F.array(out(step(acc["a"], x), x))).alias("o")), lambda acc: acc["o"])

    def over(blocks: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("a"), F.array().cast("array<bigint>").alias("o"))
        carried = F.aggregate(blocks, first, lambda acc, block: F.struct(F.aggregate(block, acc["a"], step).alias("a"), F.concat(acc["o"], F.array(acc["a"])).alias("o")), lambda acc: acc["o"])
        return F.flatten(F.zip_with(blocks, carried, gathered))

    def parted(every: Column) -> Column:
        last = F.greatest(F.ceil(F.size(every) / BLOCK).cast("int") - 1, F.lit(0))
        return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(every, b * BLOCK + 1, F.lit(BLOCK))), over)

    return let(items, parted)


def found(text: Column, pattern: str, needs: str) -> Column:
    """All matches as (text, start, end, signs before and after): the parts between them give the
    places.  The signs before a match reach back to the start of the match before it at most."""
    text = F.coalesce(text, F.lit(""))
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)

    def matched(both: Column) -> Column:
        h, g = both["h"], both["g"]
        before = lambda i: F.right(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), F.get(g, i)), F.lit(CONTEXT))
        return F.transform(h, lambda x, i: F.struct(x.alias("h"), F.char_length(F.get(g, i)).alias("g"), F.char_length(x).alias("n"), before(i).alias("b"), F.left(F.get(g, i + 1), F.lit(2)).alias("f")))

    pairs = let(F.struct(hits.alias("h"), gaps.alias("g")), matched)
    span = lambda end, p: F.struct(p["h"].alias("t"), (end - p["n"]).cast("int").alias("s"), end.cast("int").alias("e"), p["b"].alias("b"), p["f"].alias("f"))
    spans = scanned(pairs, lambda at, p: at + p["g"] + p["n"], span, _SPAN)
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.sequence(F.lit(1), F.char_length(number))
    one = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")
    total = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, one(i)).otherwise(one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0)))
    return (F.char_length(number) > 0) & (total % 10 == 0)


def valid(kind: str, x: Column) -> Column:
    n = F.char_length(digits(x))
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return x.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(x))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda x: valid(kind, x["t"])


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["t"].alias("t"), x["s"].alias("s"), x["e"].alias("e"), x["b"].alias("b"), x["f"].alias("f"))


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the valid base spans of each kind: arrays _email, _ip, _card, _phone."""
    raw = df.withColumns({f"_{k}": found(F.col(text), BASE[k], NEEDS[k]) for k in KINDS})
    return raw.withColumns({f"_{k}": F.filter(f"_{k}", _valid(k)) for k in KINDS if k != "email"})


def _uncovered(loose: str, base: str) -> Column:
    """Candidates that lie in no base span: one scan by start, with the furthest end of base spans so far."""
    kind = "struct<s:int,base:int,e:int,kind:string,t:string,b:string,f:string>"
    shape = lambda x, is_base: F.struct(x["s"].alias("s"), F.lit(is_base).alias("base"), x["e"].alias("e"), x["kind"].alias("kind"), x["t"].alias("t"), x["b"].alias("b"), x["f"].alias("f"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: shape(x, 0)), F.transform(loose, lambda x: shape(x, 1))))
    judged = scanned(
        every,
        lambda end, x: F.when(x["base"] == 0, F.greatest(end, x["e"].cast("long"))).otherwise(end),
        lambda end, x: F.struct(x["s"].alias("s"), F.when((x["base"] == 1) & (end < x["e"]), 1).otherwise(0).alias("base"), x["e"].alias("e"), x["kind"].alias("kind"), x["t"].alias("t"), x["b"].alias("b"), x["f"].alias("f")),
        kind,
    )
    return F.filter(judged, lambda x: x["base"] == 1)


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_more``: further candidates with their features as bits of a number."""
    base = F.concat(*[F.transform(f"_{k}", _named(k)) for k in KINDS])
    loose = F.concat(*[F.transform(found(F.col(text), p, LOOSE_NEEDS[k]), _named(k)) for k, p in LOOSE.items()])
    df = df.withColumn("_loose", loose).withColumn("_base", base)
    df = df.withColumn("_loose", F.when(F.size("_loose") > 0, _uncovered("_loose", "_base")).otherwise(F.array().cast("array<struct<s:int,base:int,e:int,kind:string,t:string,b:string,f:string>>")))

    def scored(c: Column) -> Column:
        before, after = c["b"], c["f"]
        n, t = F.char_length(c["t"]), c["t"]
        d = F.char_length(digits(t))
        tests = {
            "telling": before.rlike(TELLING),
            "quoted": before.rlike(r"[\"'\x60]$") & after.rlike(r"^[\"'\x60]"),
            "assigned": before.rlike(r"[=:]\s*[\"'\x60]?$"),
            "digits": d * 2 >= n,
            "letters": d == 0,
            "mixed_case": t.rlike("[a-z]") & t.rlike("[A-Z]"),
            "luhn": F.when(d.between(13, 19), luhn(digits(t))).otherwise(False),
            "hex": t.rlike("^[0-9a-fA-F]++$"),
            "long": n >= 32,
            "separated": t.rlike(r"[\x20().-]"),
            "edge": (F.char_length(before) == 0) | before.rlike(r"\s$"),
            "both": t.rlike("[A-Za-z][0-9]") & t.rlike("[0-9][A-Za-z]"),
            "cut": t.rlike("[A-Za-z]{3}[_/-][A-Za-z]{3}"),
            "marked": t.rlike("[)-]"),
            **{k: c["kind"] == k for k in ("email", "phone", "card")},
        }
        bits = sum((F.when(tests[f], 1 << i).otherwise(0) for i, f in enumerate(FEATURES)), F.lit(0))
        return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), bits.alias("bits"))

    return df.withColumn("_more", F.transform("_loose", scored)).drop("_loose", "_base")


#: Parts of the made-up sentences: what may stand before personal data, and before anything.
ASKING = ("token = \"", "password: ", "api_key = '", "secret key ", "e-mail: ", "mail ", "phone ", "tel. ", "call ", "card ", "visa: ", "contact: ", "passwort: ", "account ")
PLAIN = ("", "see ", "commit ", "item ", "page ", "file ", "line = ", "version: ", "order ", "part \"", "sum: ", "on ", "de ", "von ")
FILL = ("the river runs", "une petite maison", "der alte Turm", "la casa blanca", "as noted above,", "Siehe oben.", "x = 1;", "(draft)")


def examples(spark: SparkSession, n: int = EXAMPLES, seed: int = 5) -> DataFrame:
    """Sentences with one planted string each: id, text, kind and place of the string, and whether it is personal."""
    part = lambda k: F.md5(F.concat_ws(":", F.lit(seed), F.col("id"), F.lit(k)))
    pick = lambda n, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    one = lambda of, k: F.element_at(F.array(*map(F.lit, of)), (pick(len(of), k) + 1).cast("int"))
    number = lambda k, n: F.substring(F.translate(F.concat(part(k), part(k + 100)), "abcdef", "024682"), 1, n)
    word = lambda k, n: F.substring(F.translate(part(k), "0123456789", "etaoinshrd"), 1, n)
    key = F.regexp_replace(F.base64(F.encode(F.substring(F.concat(part(1), part(2)), 1, 24), "UTF-8")), "=", "")
    hexed = F.substring(F.concat(part(1), part(2)), 1, 64)
    body = F.concat(F.lit("4"), number(3, 14))
    check = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(body, d.cast("string")))), 1).cast("string")
    wrong = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: ~luhn(F.concat(body, d.cast("string")))), 1).cast("string")
    spaced = lambda x, by: F.concat_ws(by, *[F.substring(x, 4 * i + 1, 4) for i in range(4)])
    sized = lambda x, sizes: F.substring(x, F.lit(1), F.element_at(F.array(*map(F.lit, sizes)), (pick(len(sizes), 7) + 1).cast("int")))
    values = [
        ("email", True, F.concat(word(1, 5), F.lit("."), word(2, 6), F.lit(" [at] "), word(3, 7), F.lit(" [dot] org"))),
        ("email", True, F.concat(word(1, 8), F.lit("(at)"), word(3, 7), F.lit(".com"))),
        ("email", False, F.concat(word(1, 4), F.lit(" (at) "), word(2, 5), F.lit(". "), word(3, 6))),
        ("phone", True, F.concat(number(1, 3), F.lit("-"), number(2, 3), F.lit("-"), number(3, 4))),
        ("phone", True, F.concat(F.lit("("), number(1, 3), F.lit(") "), number(2, 3), F.lit(" "), number(3, 4))),
        ("phone", False, F.concat(number(1, 3), F.lit("."), number(2, 4), F.lit("."), number(3, 4))),
        ("phone", False, F.concat(number(1, 3), F.lit(" "), number(2, 3), F.lit(" "), number(3, 4))),
        ("card", True, F.concat(spaced(F.concat(body, check), " "), F.lit(" "), number(5, 3))),
        ("card", True, F.concat(body, check, F.lit(" "), number(5, 2))),
        ("card", False, F.concat(spaced(F.concat(body, wrong), " "), F.lit(" "), number(5, 3))),
        ("card", False, F.concat(body, wrong)),
        ("secret", True, sized(hexed, (32, 40, 64))),
        ("secret", True, sized(key, (22, 28, 32))),
        ("secret", True, F.concat(one(("sk_live_", "ghp_", "xoxb-"), 9), key)),
        ("secret", False, sized(hexed, (32, 40, 64))),
        ("secret", False, F.concat_ws("-", word(1, 5), word(2, 7), word(3, 4), word(4, 8))),
        ("secret", False, F.concat_ws("_", word(1, 6), word(2, 5), word(3, 9), word(4, 3))),
        ("secret", False, F.concat_ws("/", word(1, 6), word(2, 5), word(3, 9), word(4, 3))),
        ("secret", False, F.concat(word(1, 15), word(2, 13))),
        ("secret", False, F.concat(F.initcap(word(1, 9)), F.initcap(word(2, 8)), F.initcap(word(3, 7)))),
        ("secret", False, sized(F.concat(number(1, 20), number(2, 20)), (20, 24, 31))),
    ]
    at, chosen = F.pmod(F.col("id"), F.lit(len(values))), lambda i: F.coalesce(*[F.when(F.col("_at") == k, F.lit(v[i]) if i < 2 else v[i]) for k, v in enumerate(values)])
    rows = spark.range(n).withColumn("_at", at)
    rows = rows.select("id", chosen(0).alias("kind"), chosen(1).alias("personal"), chosen(2).alias("_value"))
    telling = F.when(F.col("personal"), pick(10, 20) < 7).otherwise(pick(10, 20) < 1)
    rows = rows.withColumn("_before", F.concat(one(FILL, 21), F.lit(" "), F.when(telling, one(ASKING, 22)).otherwise(one(PLAIN, 23))))
    close = F.regexp_extract("_before", "[\"']$", 0)
    text = F.concat("_before", "_value", close, F.lit(" "), one(FILL, 24))
    start = F.char_length("_before")
    return rows.select("id", text.alias("text"), "kind", "personal", start.alias("start"), (start + F.char_length("_value")).alias("end"))


@dataclass(frozen=True)
class Boosted:
    """Trees of depth two: (feature, feature, four leaves by their bits), and of each kind its
    threshold with the precision and recall that it has on the rows held back."""

    trees: tuple[tuple[int, int, tuple[float, float, float, float]], ...]
    base: float
    thresholds: tuple[tuple[str, float, float, float], ...]

    def score(self, bits: int) -> float:
        return self.base + sum(v[(bits >> a & 1) * 2 + (bits >> b & 1)] for a, b, v in self.trees)

    def column(self, bits: Column) -> Column:
        total = F.lit(self.base)
        for a, b, v in self.trees:
            at = F.shiftright(bits, a).bitwiseAND(1) * 2 + F.shiftright(bits, b).bitwiseAND(1)
            total = total + F.element_at(F.array(*[F.lit(float(x)) for x in v]), at + 1)
        return total

    def selects(self, kind: Column, bits: Column) -> Column:
        least = F.coalesce(*[F.when(kind == k, F.lit(t)) for k, t, _, _ in self.thresholds], F.lit(math.inf))
        return self.column(bits) >= least


def boosted(counts: list[tuple[int, int, int]]) -> tuple[list, float]:
    """Gradient boosting of logistic loss on rows (bits, rows, personal ones among them): trees and their base."""
    total = sum(n for _, n, _ in counts)
    share = (sum(y for _, _, y in counts) + 0.5) / (total + 1.0)
    base = math.log(share / (1 - share))
    score, trees, m = [base] * len(counts), [], len(FEATURES)
    for _ in range(TREES if counts else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        best = None
        for a in range(m):
            for b in range(a + 1, m):
                g, h = [0.0] * 4, [1.0] * 4
                for (bits, n, y), q in zip(counts, p):
                    at = (bits >> a & 1) * 2 + (bits >> b & 1)
                    g[at] += y - n * q
                    h[at] += n * q * (1 - q)
                gain = sum(x * x / w for x, w in zip(g, h))
                if best is None or gain > best[0] + 1e-12:
                    best = gain, a, b, tuple(max(-4.0, min(4.0, RATE * x / w)) for x, w in zip(g, h))
        _, a, b, leaves = best
        trees.append((a, b, leaves))
        score = [s + leaves[(bits >> a & 1) * 2 + (bits >> b & 1)] for s, (bits, _, _) in zip(score, counts)]
    return trees, base


def calibrated(scored: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """The least score at which precision is enough on (score, rows, personal ones), and precision and recall there."""
    every, out = sum(y for _, _, y in scored), (math.inf, 1.0, 0.0)
    good, met = 0, 0
    for score in sorted({s for s, _, _ in scored}, reverse=True):
        good += sum(y for s, _, y in scored if s == score)
        met += sum(n for s, n, _ in scored if s == score)
        if (good + 0.5) / (met + 1.0) >= PRECISION:
            out = score - 1e-9, good / met, good / every
    return out


@lru_cache(maxsize=4)
def _fitted(session: int, n: int) -> Boosted:
    spark = SparkSession.active()
    more = with_candidates(with_base(written(examples(spark, n)))).select("id", "kind", "personal", "start", "end", F.explode("_more").alias("c"))
    hit = F.col("personal") & (F.col("c.kind") == F.col("kind")) & (F.col("c.s") < F.col("end")) & (F.col("c.e") > F.col("start"))
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(10)) < 3
    rows = more.groupBy(held.alias("held"), F.col("c.kind").alias("of"), F.col("c.bits").alias("bits")).agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("y"))
    rows = sorted((r["held"], r["of"], r["bits"], r["n"], r["y"]) for r in rows.collect())
    trees, base = boosted([(b, n, y) for held, _, b, n, y in rows if not held])
    model = Boosted(tuple(trees), base, ())
    kinds = []
    for k in LOOSE:
        kinds.append((k, *calibrated([(model.score(b), n, y) for held, of, b, n, y in rows if held and of == k])))
    return Boosted(tuple(trees), base, tuple(kinds))


def fitted(spark: SparkSession, n: int = EXAMPLES) -> Boosted:
    """The classifier of ``n`` made-up sentences; the driver gets their counts by feature pattern."""
    return _fitted(id(spark), n)


def detected(df: DataFrame, text: str = "text", model: Boosted | None = None) -> DataFrame:
    """``df`` with ``base_spans`` and ``spans``: arrays of (kind, start, end), base kinds first in their order."""
    model = fitted(df.sparkSession) if model is None else model
    kept = [c for c in df.columns if c not in ("base_spans", "spans")]
    named = with_candidates(with_base(df.select(*kept), text), text)
    one = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("start"), x["e"].alias("end"))
    base = F.concat(*[F.transform(f"_{k}", one(k)) for k in KINDS])
    chosen = F.filter("_more", lambda c: model.selects(c["kind"], c["bits"]))
    added = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("start"), c["e"].alias("end")))
    every = []
    for k in (*KINDS, "secret"):
        both = F.filter(F.concat("base_spans", "_added"), of_kind(k))
        every.append(F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    every = F.when(F.size("_added") > 0, F.concat(*every)).otherwise(F.transform("base_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    named = named.withColumn("base_spans", base).withColumn("_added", added).withColumn("spans", every)
    shaped = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return named.select(*kept, "base_spans", shaped.alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(df: DataFrame, text: str = "text", spans: str = "spans", out: str = "redacted") -> DataFrame:
    """``df`` with the text whose spans are replaced by ``<KIND>``, overlapping ones by the first."""
    body = F.coalesce(F.col(text), F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("t"))
    step = lambda a, x: F.when(x["s"] < a["at"], a).otherwise(
        F.struct(x["e"].alias("at"), F.concat(a["t"], F.substring(body, a["at"] + 1, x["s"] - a["at"]), F.lit("<"), F.upper(x["k"]), F.lit(">")).alias("t"))
    )
    rest = lambda a: F.concat(a["t"], F.substring(body, a["at"] + 1, F.char_length(body)))
    return df.withColumn(out, F.aggregate(ordered, start, step, rest))
