"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Each kind is one pattern, searched leftmost and without overlap. The text between the matches
(split) and the matches (extract) give every span's place by prefix sums of their lengths, so
places are code points and no text leaves its row. Luhn confirms cards, mod-97 confirms IBANs, an
assigned secret needs a digit and a letter in its value. A span's score begins with its kind's; words
of the kind's context within NEAR code points raise it, words that speak against it (of the kind, or
of made-up data) lower it. The four base kinds are reported by their checks alone, with their score;
an added kind also needs a score of MIN_SCORE.

redacted() puts kinds in place of the very spans that found() reports.

Defined cases. A null or empty text has no spans and redacts to itself. Rows are handled one by
one, so repeated rows give repeated results and a null doc_id is kept. Spans of two kinds may
overlap; both are reported. Spans that overlap are redacted together, by the kind that begins first
(of those that begin together, the first in KINDS). Very long texts: patterns are possessive and
anchored, so a run of a million equal characters costs one pass. An input column pii_spans is
replaced; no other name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeloom.llm.text import bound, fenced, nested, total, unnested, whole


@dataclass(frozen=True)
class Kind:
    """start_in: the class that a run of the pattern's first part consists of.

    A match can begin only where such a run begins or where the last match ended; saying so
    keeps the search linear and changes no match.
    """

    name: str
    pattern: str
    must_have: str
    score: float
    context: str
    against: str = ""
    added: bool = False


#: Lengths of IBANs by country, those of countries outside the registry included.
_LENGTHS = """15 NO|16 BE|18 DK FI FO FK GL NL SD|19 MK SI|20 AT BA EE KZ LT LU MN XK|21 CH HR LI LV|22 BG BH CR DE GB GE IE ME RS VA
23 AE GI IL IQ OM SO TL|24 AD CZ ES MD PK RO SA SE SK TN VG|25 AO CV GW LY MZ PT ST|26 DZ IR IS TR|27 BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD
28 AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG|29 BR EG PS QA UA|30 JO KW MU|31 MT SC|32 LC|33 RU"""
_COUNTRIES = {codes[0]: codes[1:] for codes in (part.split() for part in _LENGTHS.replace("\n", "|").split("|"))}
_KNOWN = "(?:" + "|".join(c for codes in _COUNTRIES.values() for c in codes) + ")"


def _iban() -> str:
    """A known country's number has that country's length, so the next word is none of it. Other codes
    take the longest run, up to a known country's number."""
    known = "|".join(f"(?:{'|'.join(codes)})[0-9]{{2}}(?:\\x20?+[A-Z0-9]){{{int(n) - 4}}}" for n, codes in _COUNTRIES.items())
    other = rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_KNOWN}[0-9]{{2}})\x20?+[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})(?![A-Za-z0-9])"


#: The forms that providers give their keys.
_ISSUED = "|".join(
    (
        r"(?:AKIA|ASIA)[0-9A-Z]{16}",
        r"gh[oprsu]_[A-Za-z0-9]{36,}+",
        r"github_pat_[A-Za-z0-9_]{22,}+",
        r"glpat-[A-Za-z0-9_-]{20,}+",
        r"xox[abeoprs]-[A-Za-z0-9-]{10,}+",
        r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+",
        r"AIza[A-Za-z0-9_-]{35}",
        r"npm_[A-Za-z0-9]{36}",
        r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    )
)
_NAMED = r"(?:api|access|auth|client|private|secret)[_-]?key|(?:[A-Za-z]{1,16}[_-])?(?:token|secret)|password|passwd|pwd"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write|address"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|host|server|address|client", r"version|release|build"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "", 0.7, r"card|visa|credit|debit|payment|number", r"isbn|order|serial|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"phone|tel|call|mobile|fax|number"),
    Kind("iban", _iban(), "", 0.6, r"iban|bank|account|konto|compte|cuenta", r"serial|article", True),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", 0.3, r"ssn|social|security|tax", r"serial|order|part|isbn|invoice", True),
    Kind("tel", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])", "", 0.3, r"phone|tel\b|call|mobile|fax", r"order|serial", True),
    Kind("ip6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]|\.[0-9])", ":", 0.6, r"\bip|host|server|address|client", "", True),
    Kind("secret", rf"(?i)(?<![A-Za-z0-9])(?:{_NAMED})[\"']?[\x20\t]?[:=][\x20\t]?[\"']?[A-Za-z0-9+/_.~=-]{{8,}}+[\"']?", "", 0.6, r"config|deploy|login|env|auth", "", True),
    Kind("token", rf"(?<![A-Za-z0-9_-])(?:{_ISSUED})(?![A-Za-z0-9_-])", "", 0.8, r"key|token|secret|auth", "", True),
    Kind("key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)?", "PRIVATE KEY-----", 0.9, r"ssh|rsa|pem", "", True),
)
#: Words by which a text says that what stands beside them is made up.
MADE_UP = r"(?<![@.\w])(?:example|sample|dummy|placeholder|fake|specimen)(?![.@\w])"
BASE = tuple(k.name for k in KINDS if not k.added)
MIN_SCORE = 0.5
#: Code points on either side of a span that count as its context.
NEAR = 40
RAISE, LOWER = 0.3, 0.3
BLOCK = 64


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass Luhn's check; every second one from the right is doubled."""

    def worth(i: Column) -> Column:
        d = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return total(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth)) % 10 == 0


def mod97(match: Column) -> Column:
    """True if an IBAN's number, with the first four characters moved to its end, is 1 modulo 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), step) == 1)


def octets(match: Column) -> Column:
    """True if each part of a dotted number is at most 255, whatever zeros it begins with."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


CHECKS = {
    "ip": octets,
    "card": lambda m: F.length(digits_of(m)).between(14, 19) & luhn(digits_of(m)),
    "phone": lambda m: F.length(digits_of(m)).between(10, 15),
    "iban": mod97,
    "secret": lambda m: bound(F.regexp_replace(m, "^[^:=]*", ""), lambda v: F.regexp_like(v, F.lit("[0-9]")) & F.regexp_like(v, F.lit("[A-Za-z]"))),
}


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(kind.must_have)), found).otherwise(none) if kind.must_have else found


def _spans(df: DataFrame, kind: Kind, order: int) -> DataFrame:
    """Add _s_<kind>: the confirmed spans, from _text."""
    m, p, lens, sums, offs = (f"_{x}_{kind.name}" for x in "mplbo")
    df = df.withColumn(m, _matches(F.col("_text"), kind))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split("_text", kind.pattern)))
    df = df.withColumn(lens, F.when(F.size(m) > 0, F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b))))
    # prefix sums: of whole blocks, and inside a block by a short sum
    df = df.withColumn(sums, F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)))))
    first = F.array(F.lit(0).cast("long"))
    df = df.withColumn(offs, F.aggregate(sums, first, lambda a, s: F.array_append(a, F.element_at(a, -1) + s)))

    def score(around: Column) -> Column:
        said = lambda words, change: F.when(F.regexp_like(around, F.lit(words)), change).otherwise(0.0)
        moved = F.lit(kind.score) + said(kind.context, RAISE) - said(MADE_UP, LOWER)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(moved - said(kind.against, LOWER) if kind.against else moved, 2)))

    def span(match: Column, k: Column) -> Column:
        block = F.floor(k / BLOCK).cast("int")
        start = F.get(offs, block) + total(F.slice(lens, block * BLOCK + 1, k - block * BLOCK)) + F.length(F.get(p, k))
        around = F.lower(F.concat(F.right(F.get(p, k), F.lit(NEAR)), F.lit(" "), F.left(F.get(p, k + 1), F.lit(NEAR))))
        ok = CHECKS[kind.name](match) if kind.name in CHECKS else F.lit(True)
        return F.struct(start.alias("start"), F.lit(order).alias("rank"), (start + F.length(match)).alias("end"), F.lit(kind.name).alias("kind"), bound(around, score).alias("score"), ok.alias("ok"))

    good = F.filter(F.transform(m, span), lambda s: s["ok"] & (s["score"] >= MIN_SCORE) if kind.added else s["ok"])
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,ok:boolean>>")
    return df.withColumn(f"_s_{kind.name}", F.when(F.size(m) > 0, good).otherwise(none)).drop(m, p, lens, sums, offs)


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add pii_spans: array of (start, rank, end, kind, score), by start and then kind."""
    out = nested(docs, whole(F.col(text)).alias("_text"))
    for order, kind in enumerate(KINDS):
        out = _spans(out, kind, order)
    names = [f"_s_{k.name}" for k in KINDS]
    plain = F.transform(F.sort_array(F.concat(*names)), lambda s: s.dropFields("ok"))
    return unnested(fenced(out.withColumn("pii_spans", plain).drop("_text", *names), "pii_spans"), docs.columns, "pii_spans")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scored(spans: Column) -> Column:
    """Spans as kind:start:end:score, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"], s["score"])), ",")


def _merged(spans: Column) -> Column:
    """Spans in order -> (start, end, kind) of what they cover, spans that overlap as one."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.transform(F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)), lambda s: s["end"])))
    so_far = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.greatest(F.element_at(a, -1), x)))

    def merge(most: Column) -> Column:
        def before(k: Column) -> Column:
            """Where the spans before the k-th end: by the blocks before its own, and in its own."""
            block = F.floor(k / BLOCK).cast("int")
            near = F.transform(F.slice(spans, block * BLOCK + 1, k - block * BLOCK), lambda s: s["end"])
            return F.greatest(F.get(most, block), F.coalesce(F.array_max(near), F.lit(0).cast("long")))

        first = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: F.get(spans, k)["start"] >= before(k))
        one = lambda heads: F.transform(heads, lambda k, j: F.struct(F.get(spans, k)["start"].alias("start"), before(F.coalesce(F.get(heads, j + 1), F.size(spans))).alias("end"), F.get(spans, k)["kind"].alias("kind")))
        return bound(first, one)

    return bound(so_far, merge)


def _replaced(text: Column, spans: Column) -> Column:
    """The text with its spans' kinds; it is cut once for every BLOCK places, and each cut in them."""

    def pieces(places: Column) -> Column:
        end_before = lambda j: F.when(j > 0, F.get(places, j - 1)["end"]).otherwise(F.lit(0).cast("long"))
        cut = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))

        def block(b: Column) -> Column:
            first = b * BLOCK
            begin, end = end_before(first), end_before(F.least(first + BLOCK, F.size(places)))
            mark = lambda part: lambda s, i: F.concat(cut(part, end_before(first + i) - begin, s["start"] - begin), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return bound(cut(text, begin, end), lambda part: F.array_join(F.transform(F.slice(places, first + 1, F.lit(BLOCK)), mark(part)), ""))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(places) - 1) / BLOCK).cast("int")), block)
        return F.concat(F.array_join(blocks, ""), F.substr(text, (F.element_at(places, -1)["end"] + 1).cast("int")))

    return bound(_merged(spans), pieces)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span that found() reports by its kind in brackets; other texts stay as they are.

    Texts with spans are searched a second time: a phone number, say, that ran into an address with
    digits and had too many can be told from it once the address is gone.
    """
    spans, left = F.col("pii_spans"), F.col("_text")
    out = found(nested(docs, F.col(text).alias("_text")), "_text")
    out = out.withColumn("_text", F.when(F.size(spans) > 0, _replaced(left, spans)).otherwise(left))
    again = out.select("_doc", left, F.when(F.size(spans) > 0, left).otherwise(F.lit("")).alias("_again"))
    out = found(again, "_again").withColumn("_text", F.when(F.size(spans) > 0, _replaced(left, spans)).otherwise(left))
    return out.select(*[left.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])
