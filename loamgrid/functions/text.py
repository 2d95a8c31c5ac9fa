"""Identifiers, hashes and text fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or(x: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (x, *others)])


def parse_filename(name: Column) -> Column:
    """struct(uuid, site, leaf_core, shot, day, descriptor) of ``uuid___descriptor.ext``; absent parts are ''.

    The day suffix goes first, then the shot suffix; the site is the first word.
    """
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    parts = F.split(stem, "___", 2)
    split = F.size(parts) > 1
    uuid = F.when(split, F.trim(parts[0])).otherwise("")
    descriptor = F.trim(F.when(split, F.get(parts, 1)).otherwise(stem))
    day = F.regexp_extract(descriptor, r"(?i)\s+Day\s+(\d+)\s*$", 1)
    dayless = F.trim(F.regexp_replace(descriptor, r"(?i)\s+Day\s+(\d+)\s*$", ""))
    shot = F.regexp_extract(dayless, r"\.(\d+)$", 1)
    core = F.trim(F.regexp_replace(dayless, r"\.(\d+)$", ""))
    site = _or(F.get(F.split(core, r"\s+"), 0), descriptor, F.lit("unknown"))
    return F.struct(uuid.alias("uuid"), site.alias("site"), _or(core, site).alias("leaf_core"), shot.alias("shot"), day.alias("day"), descriptor.alias("descriptor"))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), r"(?<=.)\.[^.]*$", "")


def class_of_path(path: Column) -> Column:
    """The last folder of a path, with either kind of separator."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -2)


def harvested_class(name: Column) -> Column:
    """What stands before the last ``~~``; the whole name without one."""
    return F.when(F.instr(name, "~~") > 0, F.regexp_extract(name, "^(.*)~~", 1)).otherwise(name)


def display_name(name: Column) -> Column:
    return F.replace(F.replace(F.replace(name, F.lit("___"), F.lit(" - ")), F.lit("__"), F.lit(" ")), F.lit("_"), F.lit(" "))


def reason_token(reason: Column) -> Column:
    return F.split(reason, r"\s+")[0]


def hash_to_hex(h: Column) -> Column:
    """64 bits as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hex_to_hash(x: Column) -> Column:
    """The bit pattern as a signed long; right for all 64-bit values."""
    return F.conv(x, 16, -10).cast("long")


def gradient_hash(values: Column, width: int) -> Column:
    """Bits, first most significant: is a row-major matrix's value greater than the one on its left?"""
    starts = [r * width + c for r in range(8) for c in range(width - 1)]
    if len(starts) > 64:
        raise ValueError("a 64-bit hash needs 8 rows of 9 values at most")
    spots = F.array(*map(F.lit, starts))
    return F.aggregate(spots, F.lit(0).cast("long"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(F.when(F.get(values, i + 1) > F.get(values, i), F.lit(1)).otherwise(0).cast("long")))


def token_hash(token: Column) -> Column:
    """The leading 64 bits of a token's md5."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("long")


def simhash(tokens: Column) -> Column:
    """64-bit SimHash of distinct tokens: a bit is set if more tokens' hashes have it than not.

    Three bits are counted at a time, in lanes of 21 bits of one number, which
    hold the counts of up to two million tokens.
    """
    hashes = F.transform(F.array_distinct(tokens), lambda t: token_hash(t))
    lanes, step = (1 << 42) + (1 << 21) + 1, 21

    def counts(hs: Column, shift: int) -> Column:
        mask = 1 if shift == 63 else lanes
        return F.aggregate(hs, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(mask).cast("long")))

    def bits(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(64):
            lane, shift = (0, 63) if k == 63 else divmod(k, step)
            count = F.shiftrightunsigned(x["ones"][step if k == 63 else shift], step * lane).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
            bit = (1 << k) - (1 << 64 if k == 63 else 0)
            out = out.bitwiseOR(F.when(2 * count > x["n"], F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    counted = F.transform(F.array(hashes), lambda hs: F.struct(F.array(*[counts(hs, s) for s in (*range(step), 63)]).alias("ones"), F.size(hs).alias("n")))
    return F.transform(counted, bits)[0]


def number_of(fields: dict[str, Column], *keys: str) -> Column:
    """The first of the keys' fields that is there, as a number; null if it isn't one."""
    lower = {k.lower(): c for k, c in fields.items()}
    there = [lower[k.lower()] for k in keys if k.lower() in lower]
    return F.coalesce(*[F.trim(c) for c in there]).try_cast("double") if there else F.lit(None).cast("double")


def metric_in(text: Column, pattern: str) -> Column:
    """The first number that ``pattern``'s group finds, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
