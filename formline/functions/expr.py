"""Column macros: guarded ratios, conditional aggregates, names."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from formline import vocab


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate(num: Column | str, den: Column | str) -> Column:
    """num / den, null unless den > 0."""
    return F.when(col(den) > 0, col(num) / col(den))


def total(x: Column | str) -> Column:
    """Sum that is 0 where there is nothing to sum."""
    return F.coalesce(F.sum(col(x)), F.lit(0))


def total_where(mask: Column, x: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(mask, col(x))), F.lit(0))


def mean_where(mask: Column, x: Column | str) -> Column:
    return F.avg(F.when(mask, col(x)))


def known_where(mask: Column, x: Column | str) -> Column:
    """How many non-null values of x there are under mask."""
    return F.count_if(mask & col(x).isNotNull())


def lookup(key: Column, table: dict) -> Column:
    """A literal map applied to a key; null for keys that it has not."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def share_sum(num: Column, den: Column) -> Column:
    """Ratio of sums; null for 0 / 0."""
    return F.try_divide(F.sum(num), F.sum(den))


def xwoba_numerator() -> Column:
    return F.coalesce(F.col("estimated_woba_using_speedangle"), F.col("woba_value"))


def outs_of(event: Column) -> Column:
    return reduce(lambda c, kv: c.when(event.isin(*kv[1]), kv[0]), sorted(vocab.OUTS.items(), reverse=True), F).otherwise(0)


def discipline_counts() -> list[Column]:
    """The eight counts over discipline flags."""
    names = {"InZone": "in_zone", "OutZone": "out_zone", "Swings": "is_swing", "Chases": "is_chase", "ZSwings": "is_zswing", "Contacts": "is_contact", "ZContacts": "is_zcontact", "OContacts": "is_ocontact"}
    return [F.count_if(F.col(flag)).alias(name) for name, flag in names.items()]


#: Rates over those counts.
DISCIPLINE_RATES = {
    "zone_rate": ("InZone", "Pitches"), "swing_rate": ("Swings", "Pitches"), "chase_rate": ("Chases", "OutZone"), "zswing_rate": ("ZSwings", "InZone"), "contact_rate": ("Contacts", "Swings"),
    "zcontact_rate": ("ZContacts", "ZSwings"), "ocontact_rate": ("OContacts", "Chases"), "swstr_rate": ("Whiffs", "Pitches"), "whiff_rate": ("Whiffs", "Swings"),
}


def discipline_rates() -> dict[str, Column]:
    return {name: rate(num, den) for name, (num, den) in DISCIPLINE_RATES.items()}


def first_last(name: Column | str) -> Column:
    """"Last, First" as "First Last"; other forms trimmed."""
    trimmed = F.trim(col(name).cast("string"))
    part = lambda i: F.trim(F.get(F.split(trimmed, ","), F.lit(i)))
    return F.when(part(1).isNotNull() & (part(1) != ""), F.concat(part(1), F.lit(" "), part(0))).otherwise(trimmed)


def team_code(value: Column | str) -> Column:
    """The canonical team code; unknown codes raise when the row is evaluated."""
    raw = F.upper(F.trim(col(value)))
    code = F.coalesce(lookup(raw, vocab.TEAM_ALIASES), raw)
    known = code.isin(*vocab.TEAM_IDS)
    return F.when(known | raw.isNull(), code).otherwise(F.raise_error(F.concat(F.lit("unknown team code: "), raw)).cast("string"))



def local_date(moment: Column | str, zone: str = "America/New_York") -> Column:
    """The date in a time zone at a moment of a session in UTC."""
    return F.to_date(F.from_utc_timestamp(col(moment), zone))


def sum_horizontal(names: Sequence[str]) -> Column:
    """Sum of columns in a row; null ones count 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in names])


@cache
def _ascii_letters() -> tuple[dict[str, str], dict[str, str]]:
    """Characters above ASCII that compatibility decomposition turns into one ASCII character, and those that it turns into several."""
    table = {c: x for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (x := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())}
    return {c: x for c, x in table.items() if len(x) == 1}, {c: x for c, x in table.items() if len(x) > 1}


def name_key(value: Column | str) -> Column:
    """A key for comparing names: without accents, case, generation suffixes and anything but letters and digits.

    Letters become what compatibility decomposition leaves of them in ASCII; other characters vanish, as they would on encoding to it.
    """
    single, several = _ascii_letters()
    text = col(value)
    wide = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(lookup(c, several), c)), "")
    text = F.when(text.rlike("[" + "".join(several) + "]"), wide).otherwise(text)
    ascii_name = F.lower(F.regexp_replace(F.translate(text, "".join(single), "".join(single.values())), r"[^\x00-\x7F]", ""))
    return F.regexp_replace(F.regexp_replace(ascii_name, r"\b(jr|sr|ii|iii|iv)\b\.?", ""), "[^a-z0-9]+", "")
