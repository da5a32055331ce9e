r"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust their score.

All of it is column expressions. A pattern's matches come from ``regexp_extract_all`` and the text between
them from ``split`` by the same pattern; the lengths of both, summed up, are the places, in code points, and the text
between is the context. So a text is read twice for each kind, and nothing is exploded, shuffled or cut out of the text again.
Sums run in blocks of about the root of the number of matches: a text with 10^5 matches costs some 10^7 steps, not 10^10.

Patterns never go back over a run of characters (possessive quantifiers, and a look at the character before), so that
no text makes them quadratic.

Base kinds (email, ip, card, phone) are the leftmost matches that do not overlap, of each kind; those that fail their check are dropped. These stay
whatever their score. Added spans must reach ``LEAST`` points of 100: a card number beside other numbers or with 13 digits, a phone
number without its country (by its context only), an IBAN (mod 97), a social security number (by its context only).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40  # code points of context on either side, from the last match of the kind to the next
LEAST = 60  # points that an added span needs
HELPS, HARMS = 25, -35  # points for a word that speaks for a kind, or against it, nearby
# Fixed values of the contract: patterns of the base kinds, written so that they do not go back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Patterns of the added kinds; what may stand beside a match is checked on its context.
CARD_ALONE = r"[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}"
PHONE_LOCAL = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
IBAN = r"[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\z"
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]  # in the order in which spans of one start are listed
BASE = KINDS[:4]
FOR = {
    "email": "mail email write contact",
    "ip": "ip host server address client",
    "card": "card visa mastercard amex credit debit",
    "phone": "call phone tel telephone mobile cell fax",
    "iban": "iban account bank transfer",
    "ssn": "ssn social security",
}
AGAINST = {"email": "", "ip": "version release", "card": "order invoice isbn tracking serial", "phone": "order invoice isbn serial", "iban": "serial part", "ssn": "part serial order"}
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,score:int>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def before_each(x: Column) -> Column:
    """The sum of the values before each of an array of longs, in blocks of the root of its size."""

    def of_blocks(blocks: Column) -> Column:
        return let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda block, k: let(total(F.slice(sums, F.lit(1), k)), lambda base: F.transform(block, lambda _, i: base + total(F.slice(block, F.lit(1), i)))))))

    def cut(x: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        return let(width, lambda w: of_blocks_of(x, w))

    def of_blocks_of(x: Column, w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / w).cast("int"))
        return let(F.transform(starts, lambda b: F.slice(x, b * w + 1, w)), of_blocks)

    return F.when(F.size(x) > 0, let(x, cut)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """start, end (exclusive), what and the context before and after each match, in order."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,what:string,before:string,after:string>>")

    def placed(hits: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: of_gaps(hits, gaps))

    def of_gaps(hits: Column, gaps: Column) -> Column:
        widths = F.transform(hits, lambda h, i: (F.char_length(F.get(gaps, i)) + F.char_length(h)).cast("long"))
        return let(before_each(widths), lambda sums: F.transform(hits, lambda h, i: let(F.get(sums, i) + F.char_length(F.get(gaps, i)), lambda s: one(h, i, s, gaps, hits))))

    def one(h: Column, i: Column, s: Column, gaps: Column, hits: Column) -> Column:
        tail, head = F.substring(F.get(gaps, i), -NEAR, NEAR), F.substring(F.get(gaps, i + 1), 1, NEAR)
        before = F.when(i > 0, F.concat(F.substring(F.get(hits, i - 1), -NEAR, NEAR), tail)).otherwise(tail)
        after = F.when(i + 1 < F.size(hits), F.concat(head, F.substring(F.get(hits, i + 1), 1, NEAR))).otherwise(head)
        return F.struct(s.alias("start"), (s + F.char_length(h)).alias("end"), h.alias("what"), F.substring(before, -NEAR, NEAR).alias("before"), F.substring(after, 1, NEAR).alias("after"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))


def digits(what: Column) -> Column:
    return F.regexp_replace(what, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits have a right check digit: every second one from the right counts double, less 9 above 9."""
    places = F.sequence(F.lit(1), F.char_length(number))
    worth = F.transform(places, lambda i: let(F.substring(F.reverse(number), i, F.lit(1)).cast("int") * (2 - i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d).cast("long")))
    return total(worth) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Is an IBAN's remainder 1: its first four characters go to the end, letters count 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban) - 4), F.substring(iban, 1, 4))
    places = F.sequence(F.lit(1), F.char_length(turned))

    def step(rest: Column, i: Column) -> Column:
        return let(F.ascii(F.substring(turned, i, F.lit(1))), lambda c: F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97)

    return F.aggregate(places, F.lit(0).cast("int"), lambda rest, i: step(rest, i).cast("int")) == 1


def named(context: Column, words: str) -> Column:
    """Does a context in small letters hold one of the words, whole."""
    return context.rlike(f"(^|[^a-z])({'|'.join(words.split())})([^a-z]|\\z)") if words else F.lit(False)


def points(m: Column, kind: str, start: int | Column) -> Column:
    context = F.translate(F.concat(m["before"], F.lit(" "), m["after"]), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    start = F.lit(start) if isinstance(start, int) else start
    return let(context, lambda c: (start + F.when(named(c, FOR[kind]), HELPS).otherwise(0) + F.when(named(c, AGAINST[kind]), HARMS).otherwise(0)).cast("int"))


def checked(text: Column, kind: str, pattern: str, check: Callable[[Column], Column], start: int | Callable[[Column], Column], base: bool) -> Column:
    """Spans of one pattern: matches that pass the check, with their points; added ones need LEAST."""
    good = F.filter(matches(text, pattern), check)
    rank = KINDS.index(kind)
    spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), points(m, kind, start if isinstance(start, int) else start(m)).alias("score")))
    return spans if base else F.filter(spans, lambda s: s["score"] >= LEAST)


def right_card(m: Column) -> Column:
    return let(digits(m["what"]), lambda d: F.char_length(d).between(14, 19) & F.when(F.char_length(d) <= 19, luhn(d)).otherwise(False))


def right_ip(m: Column) -> Column:
    return F.forall(F.split(m["what"], r"\."), lambda part: part.rlike(BYTE))


def right_phone(m: Column) -> Column:
    return F.char_length(digits(m["what"])).between(10, 15)


def card_alone(m: Column) -> Column:
    """A card number that is not a whole run of digits with single spaces or hyphens (a base span, if right), or has 13 digits."""
    part = m["before"].rlike(r"[0-9][\x20-]\z") | m["after"].rlike(r"^[\x20-][0-9]")
    apart = ~m["before"].rlike(r"[0-9]\z") & ~m["after"].rlike("^[0-9]")
    return apart & let(digits(m["what"]), lambda d: (part | (F.char_length(d) == 13)) & luhn(d))


def phone_local(m: Column) -> Column:
    return ~m["before"].rlike(r"([0-9]|[0-9]-|\+[\x20().0-9-]*)\z") & ~m["after"].rlike("^-?[0-9]")


def right_iban(m: Column) -> Column:
    apart = ~m["before"].rlike(r"[A-Za-z0-9]\z") & ~m["after"].rlike("^[A-Za-z0-9]")
    return apart & let(F.replace(m["what"], F.lit(" "), F.lit("")), lambda x: F.char_length(x).between(15, 34) & mod_97(x))


def right_ssn(m: Column) -> Column:
    apart = ~m["before"].rlike(r"[0-9-]\z") & ~m["after"].rlike("^[0-9-]")
    return apart & ~m["what"].rlike(r"^(000|666|9)|-00-|-0000\z")


def spans(text: Column) -> Column:
    """All spans of a text, in order of start, kind and end: start, end, kind, base, score. A null text is an empty one."""

    def found(t: Column) -> Column:
        none = F.array().cast(SPANS)
        by_digits = F.concat(
            checked(t, "ip", IP, right_ip, 50, True),
            checked(t, "card", CARD, right_card, 80, True),
            F.when(F.instr(t, "+") > 0, checked(t, "phone", PHONE, right_phone, 50, True).cast(SPANS)).otherwise(none),
            checked(t, "card", CARD_ALONE, card_alone, lambda m: F.when(F.char_length(digits(m["what"])) == 13, 50).otherwise(80), False),
            checked(t, "phone", PHONE_LOCAL, phone_local, 40, False),
            checked(t, "iban", IBAN, right_iban, 95, False),
            F.when(F.instr(t, "-") > 0, checked(t, "ssn", SSN, right_ssn, 40, False).cast(SPANS)).otherwise(none),
        )
        mails = F.when(F.instr(t, "@") > 0, checked(t, "email", EMAIL, lambda m: F.lit(True), 60, True)).otherwise(none)
        return F.array_sort(F.concat(mails.cast(SPANS), F.when(t.rlike("[0-9]"), by_digits.cast(SPANS)).otherwise(none)))

    return let(F.coalesce(text.cast("string"), F.lit("")), found)


def listed(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``pii``: spans of the text, see ``spans``.

    A null or empty text has none. Rows that repeat have the same spans; a column of the name ``pii`` is replaced.
    """
    return documents.withColumn("pii", spans(F.col(text)))


def op11_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    added = F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added")
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), added, scores)


OP11_SQL = r"""
WITH kinds(kind, rank, base, start, pattern) AS (VALUES
  ('email', 0, true, 60, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  ('ip', 1, true, 50, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  ('card', 2, true, 80, '[0-9]([\x20-]?[0-9])+'),
  ('phone', 3, true, 50, '\+[0-9][\x20().0-9-]+[0-9]'),
  ('card', 2, false, 80, '[0-9]{13,19}|[0-9]{4}([\x20-][0-9]{4}){3}'),
  ('phone', 3, false, 40, '\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}'),
  ('iban', 4, false, 95, '[A-Z][A-Z][0-9][0-9]([A-Z0-9]{11,30}|(\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?)'),
  ('ssn', 5, false, 40, '[0-9]{3}-[0-9]{2}-[0-9]{4}')),
helps(kind, helps, harms) AS (VALUES
  ('email', 'mail|email|write|contact', ''), ('ip', 'ip|host|server|address|client', 'version|release'),
  ('card', 'card|visa|mastercard|amex|credit|debit', 'order|invoice|isbn|tracking|serial'),
  ('phone', 'call|phone|tel|telephone|mobile|cell|fax', 'order|invoice|isbn|serial'),
  ('iban', 'iban|account|bank|transfer', 'serial|part'), ('ssn', 'ssn|social|security', 'part|serial|order')),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hits AS (SELECT r, kind, rank, base, start, regexp_extract_all(t, pattern) AS hs, string_split_regex(t, pattern) AS gs
         FROM docs, kinds WHERE regexp_matches(t, pattern)),
flat AS (SELECT r, kind, rank, base, start, hs, gs, unnest(hs) AS what, generate_subscripts(hs, 1) AS i FROM hits),
placed AS (
  SELECT r, kind, rank, base, start, what, (CASE WHEN i > 1 THEN hs[i - 1] ELSE '' END || gs[i])[-40:] AS b, (gs[i + 1] || coalesce(hs[i + 1], ''))[:40] AS a, regexp_replace(what, '[^0-9]', '', 'g') AS d,
         sum(length(gs[i]) + length(what)) OVER (PARTITION BY r, kind, base ORDER BY i) AS stop FROM flat),
sums AS (
  SELECT *, list_sum(list_transform(generate_series(1, least(length(d), 40)),
           lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INT WHEN d[-i] > '4' THEN d[-i]::INT * 2 - 9 ELSE d[-i]::INT * 2 END)) % 10 AS luhn,
         replace(what, ' ', '') AS bare, translate(b || ' ' || a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near FROM placed),
good AS (
  SELECT r, s.kind, rank, base, stop - length(what) AS first, stop,
         start - CASE WHEN s.kind = 'card' AND length(d) = 13 THEN 30 ELSE 0 END
         + CASE WHEN regexp_matches(near, '(^|[^a-z])(' || helps || ')([^a-z]|$)') THEN 25 ELSE 0 END
         - CASE WHEN harms <> '' AND regexp_matches(near, '(^|[^a-z])(' || harms || ')([^a-z]|$)') THEN 35 ELSE 0 END AS score
  FROM sums s JOIN helps h ON s.kind = h.kind
  WHERE CASE
    WHEN s.kind = 'ip' THEN len(list_filter(string_split(what, '.'), lambda x: NOT regexp_matches(x, '^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$'))) = 0
    WHEN s.kind = 'card' AND base THEN length(d) BETWEEN 14 AND 19 AND luhn = 0
    WHEN s.kind = 'phone' AND base THEN length(d) BETWEEN 10 AND 15
    WHEN s.kind = 'card' THEN NOT regexp_matches(b, '[0-9]$') AND NOT regexp_matches(a, '^[0-9]') AND luhn = 0
      AND (length(d) = 13 OR regexp_matches(b, '[0-9][\x20-]$') OR regexp_matches(a, '^[\x20-][0-9]'))
    WHEN s.kind = 'phone' THEN NOT regexp_matches(b, '([0-9]|[0-9]-|\+[\x20().0-9-]*)$') AND NOT regexp_matches(a, '^-?[0-9]')
    WHEN s.kind = 'iban' THEN NOT regexp_matches(b, '[A-Za-z0-9]$') AND NOT regexp_matches(a, '^[A-Za-z0-9]') AND length(bare) BETWEEN 15 AND 34
      AND list_reduce(list_prepend(0, list_transform(string_split(bare[5:] || bare[:4], ''), lambda c: (CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::INT)),
                      lambda x, y: ((CASE WHEN y < 10 THEN x * 10 ELSE x * 100 END + y) % 97)::INT) = 1
    WHEN s.kind = 'ssn' THEN NOT regexp_matches(b, '[0-9-]$') AND NOT regexp_matches(a, '^[0-9-]') AND NOT regexp_matches(what, '^(000|666|9)|-00-|-0000$')
    ELSE true END),
kept AS (SELECT *, kind || ':' || first::BIGINT || ':' || stop::BIGINT AS span FROM good WHERE base OR score >= 60),
told AS (
  SELECT r, count(*) FILTER (base AND kind = 'email') AS n_email, count(*) FILTER (base AND kind = 'ip') AS n_ip, count(*) FILTER (base AND kind = 'card') AS n_card,
         count(*) FILTER (base AND kind = 'phone') AS n_phone, coalesce(string_agg(span, ',' ORDER BY first, rank, stop) FILTER (base), '') AS base_spans,
         string_agg(span, ',' ORDER BY first, rank, stop) AS spans, count(*) FILTER (NOT base) AS n_added, string_agg(score::VARCHAR, ',' ORDER BY first, rank, stop) AS scores
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, coalesce(scores, '') AS scores
FROM docs LEFT JOIN told USING (r)
"""
