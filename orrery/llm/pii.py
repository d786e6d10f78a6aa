"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select.

Base spans are matches of fixed formats that pass their checks; they always stay. For each
kind a generator of high recall also proposes looser spans (spelled-out addresses, numbers
without a country code, ...), which may overlap anything. Format and context give each
proposal a pattern of yes/no features; trees fitted on generated examples turn it into a
probability, and a threshold calibrated for each kind on held-out examples decides. A
selected span is added unless it overlaps a base span or a likelier selected one.

Main path in DataFrame functions only, without any shuffle. Spans are found and told apart by
folds along the text (:func:`scan`), so that a text of many spans costs little more for each.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import let
from . import boosting
from .common import Sheltered, sha256, table, text_of

KINDS = ("email", "ip", "card", "phone")

# Fixed formats. Possessive repeats and look-behinds leave the leftmost matches as they are,
# and keep matching linear in the text: a run of letters is entered at its start only, or
# where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Looser proposals.
PROPOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:[(\[{]\x20?at\x20?[)\]}]|\x20at\x20|&#64;|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]++){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_: -][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,5}){1,2}(?![0-9A-Za-z-])",
}

#: Code points of context on each side that features look at.
CONTEXT = 32

#: Features: name and test, on the proposal ``m``, what stands before it and after it.
FEATURES: list[tuple[str, object]] = [
    ("has_at_sign", lambda m, a, b: m.contains("@")),
    ("bracketed_at", lambda m, a, b: m.rlike(r"[(\[{]\x20?at\x20?[)\]}]|&#64;")),
    ("bracketed_dot", lambda m, a, b: m.rlike(r"[(\[{]\x20?dot\x20?[)\]}]")),
    ("spelled_at", lambda m, a, b: m.rlike(r"\x20at\x20")),
    ("spelled_dot", lambda m, a, b: m.rlike(r"\x20dot\x20")),
    ("known_ending", lambda m, a, b: m.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|eu)$")),
    ("short_ending", lambda m, a, b: m.rlike(r"[.\x20)\]}][A-Za-z]{2,6}$")),
    ("luhn", lambda m, a, b: luhn(digits(m))),
    ("four_fours", lambda m, a, b: m.rlike(r"^[0-9]{4}(?:[^0-9][0-9]{4}){3}$")),
    ("one_separator", lambda m, a, b: F.size(F.array_distinct(F.regexp_extract_all(m, F.lit(r"([^0-9A-Fa-f])")))) <= 1),
    ("ten_digits", lambda m, a, b: F.char_length(digits(m)) == 10),
    ("phone_digits", lambda m, a, b: F.char_length(digits(m)).between(9, 15)),
    ("in_brackets", lambda m, a, b: m.rlike(r"^\(|^00[0-9]{1,3}[\x20.-]?\(")),
    ("three_three_four", lambda m, a, b: m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")),
    ("leading_zero", lambda m, a, b: m.rlike(r"^\(?0")),
    ("looks_like_date", lambda m, a, b: m.rlike(r"^(?:19|20)[0-9]{2}[\x20.-]|[\x20.-](?:19|20)[0-9]{2}$")),
    ("hex_groups", lambda m, a, b: m.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}")),
    ("bracketed_octets", lambda m, a, b: m.rlike(rf"^{OCTET}(?:\[\.\]{OCTET}){{3}}$")),
    ("word_mail", lambda m, a, b: a.rlike(r"(?i)e-?mail|contact|write|reach|adress|correo|courriel")),
    ("word_phone", lambda m, a, b: a.rlike(r"(?i)(?<![a-z0-9])(?:tel|phone|call|fax|mobile|cell|ring|telefon|telephone)")),
    ("word_card", lambda m, a, b: a.rlike(r"(?i)card|visa|credit|debit|payment|karte|carte|tarjeta")),
    ("word_host", lambda m, a, b: a.rlike(r"(?i)(?<![a-z0-9])ip(?![a-z0-9])|host|server|addr|client|peer|login")),
    ("word_other", lambda m, a, b: a.rlike(r"(?i)isbn|version|serial|order|invoice|page|chapter|section|part|model|sku|ref|id(?![a-z0-9])|no\.|grid|hash|key")),
    ("number_near", lambda m, a, b: a.rlike(r"[0-9][^A-Za-z]{0,3}$") | b.rlike(r"^[^A-Za-z]{0,3}[0-9]")),
]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    right = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return (F.char_length(d) > 0) & (F.aggregate(F.when(F.char_length(d).between(1, 64), right).otherwise(F.array(F.lit(1))), F.lit(0), lambda s, x: s + x) % 10 == 0)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
    "card": lambda m: F.char_length(digits(m)).between(13, 19) & luhn(digits(m)),
    "phone": lambda m: F.char_length(digits(m)).between(9, 15),
}


#: A match: kind, start, end (exclusive) and text.
SPANS = "array<struct<k:int,s:int,e:int,m:string>>"
#: A judged proposal, with its probability.
JUDGED = "struct<k:int,s:int,e:int,p:double>"
FAR = (1 << 31) - 1


def none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def scan(items: Column, zero: Column, step, kind: str) -> Column:
    """What a fold along an array puts out: ``step(state, x)`` gives the next state and an array of type ``kind``.

    The array is folded in blocks of about the square root of its size, whose outputs are joined at
    the end: growing one array item by item would copy it each time.
    """

    def inner(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        part = F.aggregate(block, F.struct(acc["state"].alias("state"), none(kind).alias("out")), inner)
        return let(lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")), part)

    def run(all_items: Column, n: Column) -> Column:
        width = F.ceil(F.sqrt(n)).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), n, width), lambda i: F.slice(all_items, i, width))
        folded = F.aggregate(blocks, F.struct(zero.alias("state"), none(f"array<{kind}>").alias("out")), outer)
        return F.when(n > 0, F.flatten(folded["out"])).otherwise(none(kind))

    return let(lambda x: let(run, x, F.size(x)), items)


def find(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost matches of a pattern as :data:`SPANS`.

    Spark finds matches but not their places; what lies between them, as ``split`` gives
    it, adds up to those.
    """

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["g"]
        e = s + x["n"]
        return e, F.array(F.struct(F.lit(kind).alias("k"), s.alias("s"), e.alias("e"), x["m"].alias("m")))

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        steps = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g"), F.char_length(m).alias("n")))
        return F.when(F.size(matches) > 0, scan(steps, F.lit(0), place, SPANS)).otherwise(none(SPANS))

    return let(placed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def base_spans(text: Column) -> Column:
    """Matches of the fixed formats that pass their checks, by kind as listed, then by start."""
    parts = []
    for k, kind in enumerate(KINDS):
        has = text.contains("@") if kind == "email" else text.rlike("[0-9]")
        valid = VALID[kind]
        parts.append(F.when(has, F.filter(find(text, BASE[kind], k), lambda x: valid(x["m"]))).otherwise(none(SPANS)))  # noqa: B023
    return F.concat(*parts)


def proposals(text: Column) -> Column:
    """The generators' spans of all kinds, each with the bits of its features."""
    spans = F.concat(*[find(text, PROPOSE[kind], k) for k, kind in enumerate(KINDS)])
    return F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), feature_bits(text, x).alias("bits")))


def feature_bits(text: Column, x: Column) -> Column:
    """A proposal's features as one number."""
    before = F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
    after = F.substring(text, x["e"] + 1, F.lit(CONTEXT))
    total = F.lit(0)
    for i, (_, test) in enumerate(FEATURES):
        total = total + F.when(test(x["m"], before, after), 1 << i).otherwise(0)
    return total


def examples(n: int, seed: int = 7) -> list[dict]:
    """Generated sentences with one proposal each and whether it is personal data. ``n`` bounds the sample."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 8)))
    pick = rng.choice

    def card(ok: bool) -> str:
        while True:
            x = d(16)
            total = sum(int(c) if i % 2 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(x))
            if (total % 10 == 0) == ok:
                return x

    fours = lambda x, s: s.join(x[i : i + 4] for i in range(0, 16, 4))
    end = lambda: pick(["com", "org", "net", "de", "fr", "es", "io", "eu"])
    yes = {
        0: lambda: f"{w()}{pick(['.', '_', ''])}{w()}" + pick([" (at) ", "(at)", " [at] ", "[at]", "&#64;", " at "]) + w() + pick([" (dot) ", "(dot)", " [dot] ", "[dot]", " dot "]) + end(),
        1: lambda: pick([":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)), "[.]".join(str(rng.randrange(256)) for _ in range(4))]),
        2: lambda: fours(card(True), pick([".", "/", "_", " "])),
        3: lambda: pick([f"({d(3)}) 555-{d(4)}", f"{pick('23456789')}{d(2)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}"]),
    }
    no = {
        0: lambda: pick([f"{w()} at {w()}. {w()}", f"{w()} at {w()} dot {w()}", f"{w()} at {w()}.{w()} {w()}", f"{w()} @ {w()}. {w()}"]),
        1: lambda: pick([":".join(d(2) for _ in range(8)), "[.]".join(str(rng.randrange(300, 999)) for _ in range(4))]),
        2: lambda: fours(card(False), pick([".", "/", "_", ":", "-", " "])),
        3: lambda: pick([f"{d(2)}.{d(3)}.{d(3)}", f"20{d(2)}-{d(3)}-{d(2)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(2)}", f"{d(2)}-{d(4)}-{d(2)}"]),
    }
    words = {0: ["email", "contact me:", "write to", "reach us"], 1: ["ip", "host", "server addr", "client"], 2: ["card", "visa", "credit card no"], 3: ["call", "phone:", "tel", "mobile"]}
    others = ["isbn", "version", "serial", "order", "page", "part no.", "ref", "grid"]
    rows = []
    for i in range(n):
        k, label = i % 4, i // 4 % 2
        value = (yes if label else no)[k]()
        lead = pick(words[k]) if rng.random() < (0.5 if label else 0.15) else pick(others) if rng.random() < (0.05 if label else 0.4) else w()
        rows.append({"text": f"{w()} {w()} {lead} {value} {w()} {w()}", "k": k, "y": label})
    return rows


def train(spark: SparkSession, sample: int = 3000, precision: float = 0.98) -> tuple[list[boosting.Trees], list[float]]:
    """Trees and a threshold for each kind.

    They learn from ``sample`` generated sentences (documented bound; no row of any corpus),
    which pass the same generators and features as texts do; a third is held out to
    calibrate. Returns at most ``sample`` patterns to the driver.
    """
    data = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples(sample))), "array<struct<text:string,k:int,y:int>>")).alias("r")).select("r.*")
    found = data.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(3)) == 0).withColumn("x", F.explode(proposals(F.col("text")))).where("x.k = k")
    rows = found.groupBy("k", "held", "x.bits").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).orderBy("k", "held", "bits").collect()
    models, thresholds = [], []
    for k in range(len(KINDS)):
        part = lambda held: [(r["bits"], float(r["pos"]), float(r["neg"])) for r in rows if r["k"] == k and r["held"] == held]  # noqa: B023, E731
        model = boosting.fit(part(False), len(FEATURES))
        thresholds.append(boosting.calibrate(model, part(True), precision))
        models.append(model)
    return models, thresholds


def _overlap(x: Column, y: Column) -> Column:
    return (x["s"] < y["e"]) & (y["s"] < x["e"])


def select_spans(ranked: Column) -> Column:
    """The spans, likeliest first, that overlap none selected before them."""

    def step(kept: Column, x: Column) -> Column:
        span = F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["p"].alias("p"))
        return F.when(F.exists(kept, lambda y: _overlap(x, y)), kept).otherwise(F.concat(kept, F.array(span)))

    return F.aggregate(ranked, none(f"array<{JUDGED}>"), step)


def clear_of(asked: Column, base: Column) -> Column:
    """The spans that overlap no base span, by start: one fold from the left leaves out those that begin
    before an earlier base span ends, one from the right those that end after a later one begins."""
    tagged = lambda spans, p: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), p(x).cast("double").alias("p")))
    kind = "array<struct<s:int,e:int,k:int,p:double>>"
    own = lambda x: x["p"] > 1  # noqa: E731  base spans are marked by 2

    def from_left(end: Column, x: Column) -> tuple[Column, Column]:
        return F.when(own(x), F.greatest(end, x["e"])).otherwise(end), F.when(own(x) | (x["s"] >= end), F.array(x)).otherwise(none(kind))

    def from_right(start: Column, x: Column) -> tuple[Column, Column]:
        return F.when(own(x), x["s"]).otherwise(start), F.when(~own(x) & (x["e"] <= start), F.array(x)).otherwise(none(kind))

    both = F.array_sort(F.concat(tagged(base, lambda x: F.lit(2)), tagged(asked, lambda x: x["p"])))
    return F.reverse(scan(F.reverse(scan(both, F.lit(0), from_left, kind)), F.lit(FAR), from_right, kind))


def best_apart(spans: Column) -> Column:
    """:func:`select_spans` for spans in order of start, run by run: those of different runs don't meet."""
    item = "struct<s:int,e:int,k:int,p:double>"
    end = F.struct(F.lit(FAR).alias("s"), F.lit(FAR).alias("e"), F.lit(0).alias("k"), F.lit(0.0).alias("p"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        new = x["s"] >= state["end"]
        after = F.struct(F.greatest(state["end"], x["e"]).alias("end"), F.when(new, F.array(x)).otherwise(F.concat(state["run"], F.array(x))).alias("run"))
        return after, F.when(new, F.array(state["run"])).otherwise(none(f"array<array<{item}>>"))

    zero = F.struct(F.lit(0).alias("end"), none(f"array<{item}>").alias("run"))
    runs = scan(F.concat(spans, F.array(end)), zero, step, f"array<array<{item}>>")
    rank = lambda x: F.struct((-x["p"]).alias("rank"), x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["p"].alias("p"))
    return F.flatten(F.transform(runs, lambda run: select_spans(F.array_sort(F.transform(run, rank)))))


def detect(docs: DataFrame, text_col: str = "text", model=None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of ``struct<k, s, e, p>``, in place of columns of these names.

    k counts :data:`KINDS`; s and e are code points, e exclusive; p is the probability (1 for
    base spans). Null and empty texts have no spans; every row is judged alone, so repeated
    rows agree and an empty table gives no rows.
    """
    models, thresholds = model or train(docs.sparkSession)
    given = Sheltered(docs)
    text = text_of(given[text_col])
    hints = text.rlike(r"[0-9@]|(?i)[\x20(\[{]at[\x20)\]}]")
    rows = given.rows.withColumn("found", base_spans(text)).withColumn("asked", F.when(hints, proposals(text)).otherwise(none("array<struct<k:int,s:int,e:int,bits:int>>")))

    def score(x: Column) -> Column:
        p = F.lit(0.0)
        for k, trees in enumerate(models):
            q = trees.score(x["bits"])
            p = F.when(x["k"] == k, F.when(q >= thresholds[k], q).otherwise(0.0)).otherwise(p)
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), p.alias("p"))

    rows = rows.withColumn("likely", F.filter(F.transform("asked", score), lambda x: x["p"] > 0))
    added = F.when(F.size("likely") > 0, best_apart(clear_of(F.col("likely"), F.col("found")))).otherwise(none(f"array<{JUDGED}>"))
    base = F.transform("found", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(1.0).alias("p")))
    return rows.withColumn("base", base).withColumn("spans", F.array_sort(F.concat("base", added))).select(*given.back("base", "spans"), "base", "spans")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        out = F.array(F.substring(text, at + 1, x["s"] - at), F.get(name, x["k"]))
        return F.greatest(at, x["e"]), F.when(x["s"] < at, none("array<string>")).otherwise(out)

    ends = F.aggregate(ordered, F.lit(0), lambda at, x: F.greatest(at, x["e"]))
    return F.concat(F.array_join(scan(ordered, F.lit(0), step, "array<string>"), ""), F.substring(text, ends + 1, F.char_length(text)))


def spell(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(len(KINDS))], sha256(spell(F.col("base"))).alias("base_sha256"), spell(F.col("spans")).alias("spans"))
