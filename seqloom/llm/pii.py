"""Personal data by weak supervision (native: DataFrame functions only).

Base spans come from four patterns with their checks; they always stay. Further candidates (bracketed
e-mail addresses, telephone numbers without a plus, IPv6 addresses, cards of 13 to 15 digits, secrets such as keys and tokens) are voted on, as are the base spans, by labelers:
the format, a gazetteer and the context before and after. Expectation-maximisation over the counts of vote patterns, a table whose size
only the labelers fix, estimates how reliable each labeler is; its posteriors train a logistic span
classifier, and candidates it accepts are added.

Spans are offsets in code points, end exclusive. The patterns start only where no longer match
could have started and never give back what they took, so every text takes linear time; spans are merged by running
maxima in blocks and the text is cut once, so a text of any length with many spans stays cheap. Secrets have no greatest length;
bracketed e-mail addresses keep those of the address format (64 before the sign, 63 a label).

Defined cases: null text counts as empty; a document without spans has zeros and empty lists; candidates that overlap a base
span are not added; candidates that overlap each other are all added, and masked as one; ties in place go by kind; repeated rows give
repeated results; an empty table gives no rows; very long texts are read whole; extra columns are ignored. The counts behind the
classifier are those of the whole table, so what is added to one document depends on the others; base spans do not.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import whole_text, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")  # secrets have no base pattern: all of them are candidates
CONTEXT = 24
ACCEPTED = 0.6  # the classifier's least score for a candidate beside the base spans

# The four base patterns, possessive and anchored at the first place a match can start.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further candidates, by kind.
MORE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{{1,63}}){{1,5}}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-][A-Za-z0-9_/+=-]{19,}+(?![A-Za-z0-9_/+=-])",
}
# Cheap tests that a text can hold a base span or a further candidate of the kind at all; an empty one asks for a digit.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
MORE_HINT = {"email": "at", "ip": ":", "card": "", "phone": "", "secret": ""}

# Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu")
SECRET_STARTS = r"^(?:AKIA|ASIA|AIza|gh[opsur]_|glpat-|sk-|sk_live_|xox[abprs]-|eyJ)"
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
GOOD_BEFORE = {
    "email": r"(?i)(?:mail|contact|write|reach)[^a-z]*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|ping|from)[^a-z]*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|payment|account)[^a-z]*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|dial)[^a-z]*$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|credentials?)[^a-z0-9]{0,6}$",
}
BAD_BEFORE_SECRET = r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|hash|digest|etag|revision|uuid|blob|tree|https?:/?/?)[^a-z0-9]{0,6}$"
BAD_BEFORE = r"(?i)(?:version|\bv|section|no\.|nr\.|isbn|order|ref|id|#|=)\s*$"

LABELERS = ("format", "gazetteer", "before", "edges")
ROUNDS = 40


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _running(values: Column, op, start: int = 0) -> Column:
    """``op`` over all earlier numbers, for each (``start`` for the first); by blocks, so that long arrays stay cheap."""
    width = 256
    fold = lambda a: F.aggregate(a, F.lit(start), op)

    def over(held):
        starts = F.sequence(F.lit(0), ((F.size(held) - 1) / width).cast("int"))
        return let(F.transform(starts, lambda b: F.slice(held, b * width + 1, width)), within)

    def within(blocks):
        def earlier(totals):
            return F.transform(totals, lambda _, i: fold(F.slice(totals, F.lit(1), i)))

        def placed(firsts):
            inner = lambda b, i: F.transform(b, lambda _, j: op(F.get(firsts, i), fold(F.slice(b, F.lit(1), j))))
            return F.flatten(F.transform(blocks, inner))

        return let(F.transform(blocks, fold), lambda totals: let(earlier(totals), placed))

    return let(values, lambda held: F.when(F.size(held) == 0, F.array().cast("array<int>")).otherwise(over(held)))


def _sums(lengths: Column) -> Column:
    return _running(lengths, lambda s, x: s + x)


def _greatest_before(values: Column) -> Column:
    return _running(values, lambda s, x: F.greatest(s, x))


def matches(text: Column, pattern: str) -> Column:
    """All matches in order: start, end, m, before (what stands before, at most CONTEXT) and after (one character)."""

    def placed(x):
        lengths = F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.get(x["p"], i)))
        return let(
            _sums(lengths),
            lambda sums: F.transform(
                x["m"],
                lambda m, i: let(
                    F.get(sums, i) + F.length(F.get(x["p"], i)),
                    lambda start: F.struct(
                        start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"),
                        F.substring(F.get(x["p"], i), -CONTEXT, CONTEXT).alias("before"),
                        F.substring(F.get(x["p"], i + 1), 1, 1).alias("after"),
                    ),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return let(both, lambda x: F.when(F.size(x["m"]) == 0, none).otherwise(placed(x)))


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes the Luhn check."""
    padded = F.lpad(digits, 20, "0")

    def value(i):
        d = F.substring(padded, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255")))
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _more_valid(kind: str, m: Column) -> Column:
    if kind == "card":
        return luhn(_digits(m))
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, base: bool, x: Column) -> list[Column]:
    """The labelers' votes on a match: 1 for personal data, -1 against, 0 for no opinion."""
    m, never = x["m"], F.lit(False)
    if kind == "secret":
        # A digest of a file looks like a secret: form alone has no opinion on digits and letters at random.
        form = _vote(m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9].*[0-9]"), m.rlike(r"([A-Za-z0-9_/+=-])\1{5}|^[a-z]++(?:[-_/][a-z0-9]++)++$"))
        gazetteer = _vote(m.rlike(SECRET_STARTS), m.rlike(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"))
        before = _vote(x["before"].rlike(GOOD_BEFORE[kind]), x["before"].rlike(BAD_BEFORE_SECRET))
        edges = _vote(x["before"].rlike(r"[=:]\s*[\"'`]?$") & x["after"].rlike(r"^(?:[\"'`;,\s]|$)"), x["after"].rlike(r"^[.@]") | x["before"].rlike(r"[.@]$"))
        return [form, gazetteer, before, edges]
    if kind == "email":
        known = F.regexp_extract(m, r"([A-Za-z]+)$", 1)
        gazetteer = _vote(F.lower(known).isin(*DOMAINS), F.length(known) < 2)
        form = _vote(m.rlike(r"^[A-Za-z0-9]"), m.rlike(r"\.\.|^[.-]"))
    elif kind == "ip":
        gazetteer = _vote(m.rlike(r"^(?:1[0-9]{0,2}|2[0-4]?[0-9]|[3-9][0-9]?)[.:]"), m.rlike(r"^0+[.:]|^255\."))
        form = _vote(F.lit(not base) | m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), m.rlike(r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        gazetteer = _vote(_digits(m).rlike(CARD_STARTS), _digits(m).rlike("^[0179]"))
        form = _vote(m.rlike(r"^[0-9]+$|^[0-9]{4}(?:[ -][0-9]{4}){3}$"), m.rlike(r"^[0-9][ -]"))
    else:
        gazetteer = _vote(m.rlike(r"^\+(?:1|33|34|44|49)\b") | m.rlike(r"555"), m.rlike(r"^\+0"))
        form = _vote(m.rlike(r"\([0-9]{3}\)|[0-9]{3}[-. ][0-9]{4}$"), m.rlike(r"^[0-9]{3} [0-9]{3} "))
    before = _vote(x["before"].rlike(GOOD_BEFORE[kind]), x["before"].rlike(BAD_BEFORE))
    edges = _vote((x["before"].rlike(r"(?:^|\s)$")) & x["after"].rlike(r"^(?:[\s.,;!?)]|$)"), x["before"].rlike(r"[A-Za-z0-9]$") | x["after"].rlike(r"^[A-Za-z0-9]") | never)
    return [form, gazetteer, before, edges]


def candidates(text: Column) -> Column:
    """Base spans and further candidates of all kinds, by kind and start, with the labelers' votes."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>>>")

    def of(k, base, pattern, hint, check):
        kind = KINDS[k]

        def entry(x):
            return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), F.array(*_votes(kind, base, x)).alias("votes"))

        kept = F.transform(F.filter(matches(text, pattern), lambda x: check(kind, x["m"])), entry)
        return F.when(F.instr(text, hint) > 0 if hint else text.rlike("[0-9]"), kept).otherwise(none)

    found = []
    for k, kind in enumerate(KINDS):
        if kind in BASE:
            found.append(of(k, True, BASE[kind], HINT[kind], _valid))
        found.append(of(k, False, MORE[kind], MORE_HINT[kind], _more_valid))
    return F.concat(*found)


def reliabilities(counts: dict[tuple, float]) -> dict[tuple, float]:
    """Posteriors of vote patterns by expectation-maximisation.

    ``counts`` maps (kind, votes) to a number of spans. Per kind, each labeler has a chance of every vote given
    the true class; both start at the votes' mean and are estimated in turn.
    """
    post: dict[tuple, float] = {}
    for kind in {k for k, _ in counts}:
        rows = [(v, n) for (k, v), n in counts.items() if k == kind]
        belief = {v: min(0.95, max(0.05, 0.5 + sum(v) / (2 * len(v)))) for v, _ in rows}
        for _ in range(ROUNDS):
            mass = [1.0, 1.0]
            seen: dict[tuple, float] = defaultdict(lambda: 1.0)
            for v, n in rows:
                for c, p in ((1, belief[v]), (0, 1 - belief[v])):
                    mass[c] += n * p
                    for j, vote in enumerate(v):
                        seen[j, vote, c] += n * p
            for v, _ in rows:
                odds = math.log(mass[1] / mass[0])
                for j, vote in enumerate(v):
                    odds += math.log(seen[j, vote, 1] / (mass[1] + 2)) - math.log(seen[j, vote, 0] / (mass[0] + 2))
                belief[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        post |= {(kind, v): belief[v] for v, _ in rows}
    return post


def span_classifier(counts: dict[tuple, float], post: dict[tuple, float], steps: int = 300, rate: float = 1.0) -> dict[tuple, float]:
    """Logistic weights of (kind, labeler, vote) and (kind,), fitted to the posteriors of all patterns."""
    weights: dict[tuple, float] = defaultdict(float)
    for kind in {k for k, _ in counts}:
        rows = [(v, n, post[kind, v]) for (k, v), n in counts.items() if k == kind]
        total = sum(n for _, n, _ in rows)
        for _ in range(steps):
            slope: dict[tuple, float] = defaultdict(float)
            for v, n, p in rows:
                keys = [(kind,), *((kind, j, vote) for j, vote in enumerate(v) if vote)]
                z = sum(weights[k] for k in keys)
                gap = n / total * (p - 1 / (1 + math.exp(-max(-30, min(30, z)))))
                for k in keys:
                    slope[k] += gap
            for k, g in slope.items():
                weights[k] += rate * (g - 1e-4 * weights[k])
    return dict(weights)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base, score), base spans and accepted candidates by kind and start."""
    keep = docs.select("doc_id", whole_text().alias("_text"))
    table = written(keep.select("doc_id", candidates(F.col("_text")).alias("found")), "pii-candidates")
    one = table.select(F.explode("found").alias("x"))
    counted = one.groupBy(F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["kind"], tuple(r["votes"])): float(r["n"]) for r in counted.collect()}  # at most 5 x 3^4 rows
    weights = span_classifier(counts, reliabilities(counts))

    def score(x):
        z = F.lit(0.0)
        for k in range(len(KINDS)):
            own = F.lit(weights.get((k,), 0.0))
            for j in range(len(LABELERS)):
                v = F.get(x["votes"], F.lit(j))
                own = own + F.when(v == 1, weights.get((k, j, 1), 0.0)).when(v == -1, weights.get((k, j, -1), 0.0)).otherwise(0.0)
            z = F.when(x["kind"] == k, own).otherwise(z)
        return 1 / (1 + F.exp(-z))

    scored = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), score(x).alias("score")))

    return table.select("doc_id", let(scored, settled).alias("spans"))


def settled(spans: Column) -> Column:
    """The base spans, and the candidates accepted by score that overlap none of them, by kind and start."""
    # A base span counts from its start, a candidate asks at its end (first of equals): it is clear if no base span that
    # starts before its end reaches beyond its start.
    held = F.filter(spans, lambda x: x["base"] | (x["score"] >= ACCEPTED))
    asked = F.array_sort(F.transform(held, lambda x: F.struct(F.when(x["base"], x["start"]).otherwise(x["end"]).alias("at"), x["base"].alias("base"), x.alias("x"))))

    def clear(events):
        reach = _greatest_before(F.transform(events, lambda e: F.when(e["base"], e["x"]["end"]).otherwise(0)))
        marked = let(reach, lambda r: F.transform(events, lambda e, i: F.when(e["base"] | (F.get(r, i) <= e["x"]["start"]), e["x"])))
        return F.array_sort(F.filter(marked, lambda x: x.isNotNull()))

    return let(asked, clear)


def _written_out(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts of base spans by kind, their digest, all spans written out, and the number of spans that the classifier added."""
    base = F.filter("spans", lambda x: x["base"])
    number = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)],
        F.sha2(_written_out(base).cast("binary"), 256).alias("base_sha256"),
        _written_out(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; a span that starts inside an earlier one is merged into it. Linear in text and spans."""
    width = 256
    names = F.array(*map(F.lit, KINDS))
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(x):
        def between(start, end):
            # From the touched pieces of the text only.
            first = F.floor(start / width).cast("int")
            touched = F.slice(x["pieces"], first + 1, F.floor((end - 1) / width).cast("int") - first + 1)
            return F.when(end > start, F.substring(F.array_join(touched, ""), start - first * width + 1, end - start)).otherwise("")

        def written_out(reach):
            parts = F.transform(x["placed"], lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(between(F.get(reach, i), s["start"]), F.lit("<"), F.get(names, s["kind"]), F.lit(">"))).otherwise(""))
            return let(F.array_max(F.transform(x["placed"], lambda s: s["end"])), lambda last: F.concat(F.array_join(parts, ""), between(last, x["length"])))

        return let(_greatest_before(F.transform(x["placed"], lambda s: s["end"])), written_out)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    held = F.struct(placed.alias("placed"), pieces.alias("pieces"), F.length(text).alias("length"))
    return F.when(F.size(spans) == 0, text).otherwise(let(held, cut))


def masked(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in angle brackets; columns stay, n_chars follows the text."""
    table = docs.select(F.struct(*docs.columns).alias("doc_id"), F.col("text"))
    spans = find(table)

    out = spans.select(F.col("doc_id").alias("row"), "spans")
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(replaced(F.col("row.text"), F.col("spans")))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    new = out.select(*columns)
    return new.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns) if "n_chars" in docs.columns else new
