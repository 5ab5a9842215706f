"""Personal data in texts, with DataFrame functions alone.

Regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm them, words on both sides of a span raise
or lower its score. The patterns are possessive and anchored so that they find the leftmost, longest matches of the plain patterns
in time linear in the text, without deep recursion in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_USER, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Kind -> (a cheap condition on the text, pattern). The first four are the base kinds, in the order of the result.
PATTERNS: dict[str, tuple[str, str]] = {
    "email": ("@", rf"(?:\G|(?<!{_USER})){_USER}++@{_HOST}++(?:\.{_HOST}++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # a run of digits with single separators is one match of the plain pattern; those of other than 13 to 19 digits fail
    "card": ("[0-9]", r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": ("[A-Z][0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])"),
    "ssn": ("[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "mac": ("[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])"),
    # values of keys, and tokens that name their maker
    "secret": (
        "(?i:key|secret|token|passw)|AKIA|gh[pousr]_",
        # long runs behind a space, sign or quote first, then what stands before them
        r"(?<=[ :=\"'])(?=[A-Za-z0-9+/_-]{16})(?i:(?<=(?:key|secret|token|passwd|password)[\"']?[ ]{0,3}[:=][ ]{0,3}[\"']?))[A-Za-z0-9+/_-]++|(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9_])",
    ),
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Score of a confirmed span before its context; added spans need THRESHOLD, base spans stay in any case.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "mac": 0.5, "secret": 0.8}
CONTEXT = {
    "email": "e-?mail|contact|correo|kontakt|courriel|write|address",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|mastercard|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
    "mac": "mac|device|network|interface|hardware",
    "secret": "secret|private|credential|credentials|auth",
}
#: Words that speak against a kind.
AGAINST = {
    "email": "example|noreply",
    "ip": "version|release|build|section|chapter",
    "card": "order|tracking|isbn|invoice|serial",
    "phone": "order|isbn|invoice|serial|article",
    "iban": "sample",
    "ssn": "order|part|model|serial|invoice",
    "mac": "ratio|time",
    "secret": "commit|checksum|sha1|sha256|md5",
}
CONTEXT_GAIN, CONTEXT_CHARS, THRESHOLD = 0.3, 40, 0.5
_BLOCK = 256
#: Code points of the pieces in which a text is masked.
_CHUNK = 4096


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(_digits(match)), "")

    def part(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    numbers = F.transform(F.filter(digits, lambda d: d != ""), part)
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(match: Column) -> Column:
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(a: Column, c: Column) -> Column:
        n = F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(n < 10, (a * 10 + n) % 97).otherwise((a * 100 + n) % 97)

    remainder = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return (F.length(plain).between(15, 34)) & (remainder == 1)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value as a variable of a lambda: other lambdas inside do not work it out again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _in_blocks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))


def _sums(values: Column) -> Column:
    """Running sums before each value, in blocks, so that long arrays cost less than their square."""
    prefix = lambda v: F.aggregate(v, F.struct(F.array().cast("array<bigint>").alias("a"), F.lit(0).cast("bigint").alias("s")), lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + x).alias("s")), lambda acc: acc["a"])
    total = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)
    summed = lambda blocks: F.flatten(F.zip_with(blocks, prefix(F.transform(blocks, total)), lambda block, start: F.transform(prefix(block), lambda x: x + start)))
    return _once(values, lambda v: _once(_in_blocks(v), summed))


def _proposals(kind: str) -> Column:
    """Array of (start, end, match, near) of all matches of a kind in column text; null where the text has none.

    near is the text on both sides, as far as CONTEXT_CHARS and not beyond the second match beside it.
    """
    _, pattern = PATTERNS[kind]
    matches = F.col(f"_{kind}")
    parts = F.split("text", pattern, -1)
    gaps = F.slice(parts, F.lit(1), F.size(matches))
    behind = F.slice(parts, F.lit(2), F.size(matches))
    steps = F.zip_with(gaps, matches, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    most = F.lit(CONTEXT_CHARS)
    # each of these is one pass over the matches
    joined = F.zip_with(gaps, matches, lambda g, m: F.right(F.concat(F.right(g, most), F.right(m, most)), most))
    before = F.zip_with(F.concat(F.array(F.lit("")), F.slice(joined, F.lit(1), F.size(matches) - 1)), gaps, lambda m, g: F.right(F.concat(F.right(m, most), F.right(g, most)), most))
    after = F.zip_with(behind, F.concat(F.slice(matches, F.lit(2), F.size(matches)), F.array(F.lit(""))), lambda g, m: F.left(F.concat(F.left(g, most), F.left(m, most)), most))
    near = F.zip_with(before, after, lambda x, y: F.lower(F.concat(x, F.lit("|"), y)))
    spans = F.zip_with(
        F.zip_with(_sums(steps), gaps, lambda s, g: s + F.length(g)),
        F.arrays_zip(matches.alias("m"), near.alias("n")),
        lambda s, x: F.struct(s.alias("start"), (s + F.length(x["m"])).alias("end"), x["m"].alias("match"), x["n"].alias("near")),
    )
    return F.when(F.size(matches) > 0, spans)


def _scored(kind: str) -> Column:
    says = lambda s, words: F.when(s["near"].rlike(rf"(?<![a-z])({words[kind]})(?![a-z])"), CONTEXT_GAIN).otherwise(0.0)
    score = lambda s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(SCORES[kind]) + says(s, CONTEXT) - says(s, AGAINST)))
    found = F.transform(
        F.filter(F.col(f"_{kind}_spans"), lambda s: _confirmed(kind, s["match"])),
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score(s), 2).alias("score")),
    )
    if kind not in BASE_KINDS:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    return F.coalesce(found, F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def find_spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the columns in keep, with base_spans and spans: arrays of (kind, start, end, score).

    Offsets are code points, the end exclusive. Within a kind spans do not overlap; those of different kinds may. A
    null or empty text has none. Each row stands for itself, repeated or with a null doc_id.
    """
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    base = frame.columns
    # three steps, so that no regular expression runs twice: matches, their places, the confirmed ones
    none = F.array().cast("array<string>")
    frame = frame.select(*base, *(F.when(F.contains("text", F.lit(c)) if c == "@" else F.col("text").rlike(c), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"_{k}") for k, (c, p) in PATTERNS.items()))
    frame = frame.select(*base, *(_proposals(k).alias(f"_{k}_spans") for k in PATTERNS))
    frame = frame.select(*base, *(_scored(k).alias(k) for k in PATTERNS))
    return frame.select(*base, F.concat(*BASE_KINDS).alias("base_spans"), F.concat(*PATTERNS).alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores: what find_spans() finds, as digests and lists."""
    found = find_spans(docs)
    of_kind = lambda kind: F.filter("base_spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"), scores.alias("scores"))


def _apart(spans: str) -> Column:
    """Spans by start, the longest first; those that begin inside one that stays are left out."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["back"]).cast("bigint").alias("at"), F.concat(a["out"], F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind")))).alias("out")))
    state = lambda at: F.struct(at.cast("bigint").alias("at"), nothing.alias("out"))
    # block by block, as every step copies what it has so far
    over = lambda a, block: _once(F.aggregate(block, state(a["at"]), step), lambda own: F.struct(own["at"].alias("at"), F.concat(a["out"], own["out"]).alias("out")))
    return _once(ordered, lambda o: F.aggregate(_in_blocks(o), state(F.lit(0)), over, lambda a: a["out"]))


def _masked(chunks: Column, masks: Column) -> Column:
    """The text of chunks of _CHUNK code points with masks (start, end, kind) in place of what they cover; places are looked up by chunk."""
    at = lambda place: F.coalesce(F.get(chunks, F.floor(place / _CHUNK).cast("int")), F.lit(""))
    inside = lambda place: (place % _CHUNK).cast("int")

    def piece(start: Column, end: Column) -> Column:
        i, j = F.floor(start / _CHUNK).cast("int"), F.floor(end / _CHUNK).cast("int")
        whole = F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        apart = F.concat(F.substring(at(start), inside(start) + 1, F.lit(_CHUNK)), whole, F.substring(at(end), F.lit(1), inside(end)))
        return F.when(i == j, F.substring(at(start), inside(start) + 1, (end - start).cast("int"))).otherwise(apart)

    before = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(masks, lambda m: m["end"]))
    until = F.concat(F.transform(masks, lambda m: m["start"]), F.array(F.length("text").cast("bigint")))
    kinds = F.concat(F.transform(masks, lambda m: F.concat(F.lit("["), m["kind"], F.lit("]"))), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.zip_with(before, until, piece), kinds, lambda text, kind: F.concat(text, kind)), "")


def mask(docs: DataFrame) -> DataFrame:
    """docs with every confirmed span replaced by its kind in brackets; all columns and rows stay, n_chars follows the text.

    Of overlapping spans the one that starts first is replaced, of those the longest; null texts stay null.
    """
    columns = docs.columns
    other = [c for c in columns if c not in ("doc_id", "text")]
    renamed = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(other)), F.col("text").isNull().alias("_null"))
    found = find_spans(renamed, tuple(f"_kept_{i}" for i in range(len(other))) + ("_null",))
    found = found.withColumn("_masks", F.when(F.size("spans") > 0, _apart("spans")))
    masked = _once(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)), lambda chunks: _once(F.col("_masks"), lambda masks: _masked(chunks, masks)))
    found = found.withColumn("text", F.when(F.col("_null"), F.lit(None)).when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    out = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"_kept_{i}") for i, c in enumerate(other)}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_null"), out["n_chars"]).otherwise(F.length("text").cast("long"))
    return found.select(*(out[c].cast(docs.schema[c].dataType).alias(c) for c in columns))
