"""Text and URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of licence addresses that are refused, that are allowed, and that have a name.
FORBIDDEN = ("-nd", "-nc", "/nc-", "by-nc", "by-nd", "nc-sa", "nc-nd")
PERMISSIVE = ("creativecommons.org/publicdomain/zero", "creativecommons.org/publicdomain/mark", "creativecommons.org/licenses/by/", "creativecommons.org/licenses/by-sa/")
LICENCE_NAMES = {"publicdomain/zero": "CC0-1.0", "publicdomain/mark": "PublicDomainMark-1.0", "/licenses/by-sa/": "CC-BY-SA", "/licenses/by/": "CC-BY"}
UNKNOWN_LICENCE = "UNKNOWN"
ERROR_LIMIT, ERROR_MARK = 512, "…[truncated]"


def normalise(text: Column) -> Column:
    """Lower case, runs of other than letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def base_id(track: Column) -> Column:
    """Without a last underscore and digits."""
    return F.regexp_replace(track, r"_\d+$", "")


def stem(path: Column) -> Column:
    """File name without folders and its last extension; a leading dot is not one."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def permissive(licence: Column) -> Column:
    """Whether a licence address is one of the allowed ones; a forbidden part anywhere refuses it. Null is refused."""
    low = F.lower(F.coalesce(licence, F.lit("")))
    any_of = lambda parts: F.greatest(*(F.contains(low, F.lit(x)) for x in parts), F.lit(False))
    return ~any_of(FORBIDDEN) & any_of(PERMISSIVE)


def licence_name(licence: Column) -> Column:
    low, name = F.lower(F.coalesce(licence, F.lit(""))), F.lit(UNKNOWN_LICENCE)
    for part, short in reversed(LICENCE_NAMES.items()):
        name = F.when(F.contains(low, F.lit(part)), short).otherwise(name)
    return name


def valid_catalog_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z0-9][a-z0-9._-]{0,63}$") & ~F.contains(c, F.lit("..")), F.lit(False))


def version(c: Column) -> Column:
    """Trimmed and lowered if 64 hexadecimal digits, else null."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^[0-9a-f]{64}$"), low)


def bounded_error(c: Column) -> Column:
    return F.when(F.length(c) <= ERROR_LIMIT, c).otherwise(F.concat(F.substring(c, 1, ERROR_LIMIT - len(ERROR_MARK)), F.lit(ERROR_MARK)))


def sniff(content: Column) -> Column:
    """Container of an audio file by its first bytes; null if none is known."""
    h = F.hex(F.substring(content, 1, 12))
    at = lambda i, n: F.substring(h, 2 * i + 1, 2 * n)
    hx = lambda s: s.encode().hex().upper()
    return (
        F.when((at(0, 4) == hx("RIFF")) & (at(8, 4) == hx("WAVE")), "wav")
        .when((at(0, 4) == hx("FORM")) & at(8, 4).isin(hx("AIFF"), hx("AIFC")), "aiff")
        .when(at(0, 4) == hx("fLaC"), "flac")
        .when(at(0, 4) == hx("OggS"), "ogg")
        .when(at(0, 3) == hx("ID3"), "mp3")
        .when(at(0, 2).isin("FFFB", "FFF3", "FFF2", "FFFA"), "mp3")
        .when(at(0, 4) == hx("caff"), "caf")
    )
