"""Personal data by weak supervision. DataFrame functions only.

Fixed patterns find base spans (email, ip, card, phone). Looser patterns propose further
spans (card groups inside longer digit runs, national phone numbers, spelled-out addresses,
identity numbers, secrets). Labelers vote on every span, base or proposed: format checks
(regex), lists of known beginnings, endings and cue words (gazetteer), and the words around
(context); each says yes (1), no (-1) or nothing (0). Expectation-maximisation on the counts
of vote patterns estimates how reliable each labeler is for each kind; a logistic classifier
on votes and span shape is then fitted to the resulting probabilities and decides on the
proposed spans. Base spans always stay.

What leaves the executors is one count per (kind, votes, shape): at most 6 kinds x 3^6 votes
x 4 shapes, whatever the input.

Defined cases: null texts are empty and have no spans; offsets are code points, end
exclusive; patterns are possessive or bounded and start only where a run starts, so texts of
any length take linear time; proposed spans that touch a base span are dropped; repeated rows
are searched each; with no proposed span in the whole table nothing is added.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import text_or_empty
from footfall.session import materialize

KINDS = ("email", "ip", "card", "phone", "id", "secret")  # order of the result; the first four are base kinds
BASE = 4

# Base patterns. A match can only start where its first run starts (or at the end of the match
# before it), which spares trying every place of a long run; possessive runs never step back.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PRESENT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

# Proposals beyond the base patterns: (kind, pattern, what must be present).
PROPOSED = (
    ("email", rf"(?<!{_LOCAL})[A-Za-z0-9._%+-]{{1,64}}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?[A-Za-z0-9-]{{1,63}}){{1,4}}", r"(?i)[\[(]\x20?at\x20?[\])]"),
    ("card", r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])", r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}"),
    ("phone", r"(?<![0-9+(])\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}(?![0-9])|(?<![0-9+.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])", r"[0-9]{3}[-.\x20][0-9]{4}"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    ("secret", r"(?<![A-Za-z0-9+/_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|[0-9a-f]{32,64})(?![A-Za-z0-9+/_-])", r"AKIA|gh[pousr]_|sk-|[0-9a-f]{32}"),
)

# Gazetteers and cue words, fixed lists of this operator.
_ENDINGS = "com|org|net|edu|gov|io|co|info|de|fr|es|uk|eu|us"
_KNOWN = {
    "email": rf"(?i)[.\])\x20](?:{_ENDINGS})$",
    "ip": r"^(?!0\.|127\.|255\.).*$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|33|34|44|49|39|81|86|91)\b|\([2-9]|[2-9])",
    "id": r"^(?!000|666|9[0-9]{2}-)",
    "secret": r"^(?:AKIA|gh[pousr]_|sk-)",
}
_CUES = {
    "email": r"(?i)mail|contact|write|reach", "ip": r"(?i)\bip\b|host|server|address|login|from", "card": r"(?i)card|visa|payment|credit|account",
    "phone": r"(?i)call|phone|tel\b|mobile|fax|contact", "id": r"(?i)ssn|social|iban|passport|\bid\b|account",
    "secret": r"(?i)token|secret|key|password|passwd|credential|auth",
}
_AGAINST = r"(?i)(?:version|\bv|isbn|issn|section|chapter|figure|page|order|invoice|commit|sha|md5|no\.)[\x20:=#]*$"
LABELERS = ("format", "shape", "known", "cue", "against", "apart")
SHAPES = 4
AROUND = 32  # code points of context looked at on the left


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn sum."""
    turned = F.reverse(digits)
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    total = F.aggregate(places, F.lit(0), lambda acc, k: acc + F.when(k % 2 == 1, F.substr(turned, k, F.lit(1)).cast("int")).otherwise(
        F.substr(turned, k, F.lit(1)).cast("int") * 2 - F.when(F.substr(turned, k, F.lit(1)).cast("int") > 4, 9).otherwise(0)))
    return total % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    """The base rule for a match of a base pattern."""
    if kind == "ip":
        return t.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(t)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(t)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, present: str) -> Column:
    """Leftmost non-overlapping matches as array of (s, e, t), offsets in code points.

    Splitting by the same pattern gives the gaps between the matches; running sums of gap and
    match lengths are the offsets.
    """
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("t")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(text.rlike(present), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def _of_kind(kind: str, hits: Column) -> Column:
    return F.transform(hits, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("k"), m["s"].alias("s"), m["e"].alias("e"), m["t"].alias("t")))


def _checked(kind: str, hits: Column) -> Column:
    return F.filter(hits, lambda m: _valid(kind, m["t"]))


def _base(text: Column) -> Column:
    """Array of (k, s, e, t) of all base spans in order of kind and start."""
    return F.concat(*[_of_kind(kind, _checked(kind, matches(text, PATTERNS[kind], PRESENT[kind]))) for kind in KINDS[:BASE]])


def _proposed(text: Column) -> Column:
    found = [(kind, matches(text, pattern, present)) for kind, pattern, present in PROPOSED]
    return F.concat(*[_of_kind(kind, _checked(kind, hits) if kind == "card" else hits) for kind, hits in found])


def _by_kind(k: Column, table: dict[str, Column]) -> Column:
    out = F.lit(0)
    for kind, value in table.items():
        out = F.when(k == KINDS.index(kind), value).otherwise(out)
    return out


def _yes_no(test: Column) -> Column:
    return F.when(test, 1).otherwise(-1)


def votes(text: Column, span: Column) -> Column:
    """The labelers' votes on a span as a string of +, - and 0 in the order of ``LABELERS``."""
    k, t, d = span["k"], span["t"], _digits(span["t"])
    left = F.substr(text, F.greatest(span["s"] + 1 - AROUND, F.lit(1)), F.least(span["s"], F.lit(AROUND)))
    before = F.substr(text, F.greatest(span["s"], F.lit(1)), F.least(span["s"], F.lit(1)))
    after = F.substr(text, span["e"] + 1, F.lit(1))
    form = _by_kind(k, {
        "email": _yes_no(t.contains("@")), "ip": _yes_no(_valid("ip", t)), "card": _yes_no(_valid("card", t)),
        "phone": _yes_no(F.length(d).between(8, 15)), "id": _yes_no(F.length(d) >= 9), "secret": _yes_no(F.length(t) >= 20),
    })
    distinct = F.size(F.array_distinct(F.split(t, "")))
    shape = _by_kind(k, {
        "email": _yes_no(F.length(t) <= 64), "ip": _yes_no(F.length(t) <= 15), "card": _yes_no(F.length(d) <= 19),
        "phone": _yes_no(F.length(d) >= 10), "id": _yes_no(distinct > 4), "secret": _yes_no(distinct > 8),
    })
    known = _by_kind(k, {kind: F.when(t.rlike(p), 1).otherwise(F.lit(0) if kind == "secret" else F.lit(-1)) for kind, p in _KNOWN.items()})
    cue = _by_kind(k, {kind: F.when(left.rlike(p), 1).otherwise(0) for kind, p in _CUES.items()})
    against = F.when(left.rlike(_AGAINST), -1).otherwise(0)
    apart = _yes_no(~before.rlike(r"[\p{L}\p{N}]") & ~after.rlike(r"[\p{L}\p{N}]"))
    sign = [F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in (form, shape, known, cue, against, apart)]
    return F.concat(*sign)


def _shape_class(t: Column) -> Column:
    """0 to 3 by the share of digits."""
    return F.least(F.floor(F.length(_digits(t)) * SHAPES / F.greatest(F.length(t), F.lit(1))), F.lit(SHAPES - 1)).cast("int")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with arrays ``_base`` and ``_more`` of (k, s, e, v: votes, c: shape class)."""
    read = docs.withColumn("_t", text_or_empty(text))

    def seen(spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["k"].alias("k"), m["s"].alias("s"), m["e"].alias("e"), votes(F.col("_t"), m).alias("v"), _shape_class(m["t"]).alias("c")))

    # one-element arrays hold the spans so that they are found once
    both = F.transform(F.array(F.struct(_base(F.col("_t")).alias("b"), _proposed(F.col("_t")).alias("p"))), lambda x: F.struct(
        seen(x["b"]).alias("b"),
        seen(F.filter(x["p"], lambda p: ~F.exists(x["b"], lambda b: (b["s"] < p["e"]) & (p["s"] < b["e"])))).alias("p"),
    ))
    return read.withColumn("_both", both[0]).withColumn("_base", F.col("_both.b")).withColumn("_more", F.col("_both.p")).drop("_t", "_both")


def reliabilities(counts: dict[tuple[int, str], float], rounds: int = 40) -> tuple[dict[tuple[int, str], float], dict]:
    """Expectation-maximisation over vote patterns: P(personal | votes) and, per kind, P(vote | class).

    Two classes per kind; labelers are independent given the class; add-one smoothing keeps
    unseen votes possible. The start trusts the majority of votes.
    """
    kinds = {k for k, _ in counts}
    post = {(k, v): 1 / (1 + math.exp(-(v.count("+") - v.count("-")))) for k, v in counts}
    rates: dict = {}
    for _ in range(rounds):
        for k in kinds:
            own = {v: n for (kk, v), n in counts.items() if kk == k}
            total = sum(own.values())
            yes = sum(n * post[k, v] for v, n in own.items())
            table = defaultdict(lambda: [1.0, 1.0])
            for v, n in own.items():
                for i, s in enumerate(v):
                    table[i, s][0] += n * post[k, v]
                    table[i, s][1] += n * (1 - post[k, v])
            rates[k] = ((yes + 1) / (total + 2), {key: (a / (yes + 3), b / (total - yes + 3)) for key, (a, b) in table.items()})
        for k, v in post:
            prior, table = rates[k]
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[i, s][0] / table[i, s][1]) for i, s in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


def _features(k: int, v: str, c: int) -> list[str]:
    return ["bias", f"kind{k}", f"shape{c}", f"kind{k}shape{c}"] + [f"{i}{s}" for i, s in enumerate(v)] + [f"{k}:{i}{s}" for i, s in enumerate(v)]


def span_classifier(counts: dict[tuple[int, str, int], float], post: dict[tuple[int, str], float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Logistic weights by gradient steps (AdaGrad) on pattern counts with soft targets."""
    total = sum(counts.values()) or 1.0
    rows = [(_features(k, v, c), n / total, post[k, v]) for (k, v, c), n in counts.items()]
    w: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(lambda: 1e-8)
    for _ in range(rounds):
        grad: dict[str, float] = defaultdict(float)
        for f, n, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[x] for x in f)))))
            for x in f:
                grad[x] += n * (p - y)
        for x, g in grad.items():
            g += decay * w[x]
            seen[x] += g * g
            w[x] -= rate * g / math.sqrt(seen[x])
    return dict(w)


def fit(found: DataFrame) -> dict[tuple[int, str, int], float]:
    """Probability that a span with these votes and this shape is personal data, per pattern seen."""
    each = found.select(F.explode(F.concat("_base", "_more")).alias("x")).select("x.k", "x.v", "x.c")
    rows = each.groupBy("k", "v", "c").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded: patterns, not spans
    counts = {(r.k, r.v, r.c): float(r.n) for r in rows}
    by_votes: dict[tuple[int, str], float] = defaultdict(float)
    for (k, v, _), n in counts.items():
        by_votes[k, v] += n
    post, _ = reliabilities(dict(by_votes))
    w = span_classifier(counts, post)
    return {key: 1 / (1 + math.exp(-sum(w.get(x, 0.0) for x in _features(*key)))) for key in counts}


def accepted(scores: dict[tuple[int, str, int], float], threshold: float) -> Sequence[str]:
    return sorted(f"{k}{v}{c}" for (k, v, c), p in scores.items() if p >= threshold)


def find_spans(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with arrays of (k, s, e): ``base_spans`` and ``spans`` (base and accepted), each in order of kind and start."""
    found = candidates(docs, text)
    found = materialize(found if keep_text else found.drop(text), "pii-spans")
    good = accepted(fit(found), threshold)
    yes = F.array(*[F.lit(x) for x in good]) if good else F.array().cast("array<string>")
    chosen = F.filter("_more", lambda m: F.array_contains(yes, F.concat(m["k"].cast("string"), m["v"], m["c"].cast("string"))))
    plain = lambda spans: F.transform(spans, lambda m: F.struct(m["k"].alias("k"), m["s"].alias("s"), m["e"].alias("e")))
    return found.withColumn("base_spans", plain(F.col("_base"))).withColumn(
        "spans", F.array_sort(F.array_distinct(F.concat(plain(F.col("_base")), plain(chosen))))
    ).drop("_base", "_more")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda m: m["k"] == KINDS.index(kind))).cast("long")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"].cast("string"), m["e"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; overlapping spans become one."""
    kept = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    found = find_spans(docs.select(whole, F.col(f"`{text}`").alias("_text")), "_text")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    placed = F.array_sort(F.transform("spans", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["k"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        gap = F.substr(F.col("_text"), acc["at"] + 1, F.greatest(m["s"] - acc["at"], F.lit(0)))
        return F.when(m["s"] >= acc["at"], F.struct(m["e"].alias("at"), F.concat(acc["out"], gap, F.get(names, m["k"])).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], m["e"]).alias("at"), acc["out"].alias("out")))

    rest = lambda acc: F.concat(acc["out"], F.substr(F.col("_text"), acc["at"] + 1, F.length("_text")))
    new = F.when(F.size("spans") > 0, F.aggregate(placed, start, step, rest)).otherwise(F.col("_text"))
    out = found.withColumn("_new", new)

    def column(c: str) -> Column:
        if c == text:
            return F.col("_new")
        old = F.col(f"_row.`{c}`")
        return F.when(F.size("spans") > 0, F.length("_new").cast("long")).otherwise(old) if c == "n_chars" else old

    return out.select(*[column(c).alias(c) for c in kept])
