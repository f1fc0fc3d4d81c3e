"""House numbers, postal codes, cities, states and tokens of addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import NOT_WORD_ASCII, _rewrites


def _zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def house_number(address: Column, strict: bool = False) -> Column:
    """What follows a word such as "plot no", else the first token that starts with a digit; leading zeros off.

    ``strict`` lets "no" match inside a longer word, as older data has it.
    """
    low = F.lower(F.coalesce(address, F.lit("")))
    gap = r"\s*" if strict else r"(?:\s+|[:#]\s*|\.\s*|\b)"
    after = F.regexp_extract(low, rf"\b(?:{fixed.NUMBER_WORDS}){gap}([a-z0-9/\-]+)", 1)
    if not strict:
        after = F.when(after.rlike("[0-9]"), after).otherwise(F.lit(""))
    first = F.regexp_extract(low, r"\b([0-9][a-z0-9_/\-]*)\b", 1)
    return _zeros(F.when(after != "", after).otherwise(first))


def house_number_leading(address: Column) -> Column:
    """A number, or two joined by "-" or "/", that starts the address."""
    return F.regexp_extract(F.trim(F.coalesce(address, F.lit(""))), r"^([0-9]+[-/]?[0-9]*)\s", 1)


def house_number_whole(address: Column) -> Column:
    """The whole number of a leading or street-bound premise, without leading zeros (zero stays "0")."""
    text = F.trim(F.coalesce(address, F.lit("")))
    lead = F.regexp_extract(text, r"^\s*([0-9]+[a-zA-Z]?)[\s,/-]", 1)
    street = F.regexp_extract(text, rf"(?i)\b([0-9]+)\s+(?:{fixed.HOUSE_STREETS})\b", 1)
    digits = F.regexp_extract(F.when(lead != "", lead).otherwise(street), "^([0-9]+)", 1)
    return F.when((digits != "") & (_zeros(digits) == ""), F.lit("0")).otherwise(_zeros(digits))


def house_number_any(address: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"\b([0-9]+[-/]?[0-9]*[a-zA-Z]?)\b", 1))


def house_number_digits(address: Column) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(address, F.lit(""))), "^([0-9]+)", 1)


def postal_code(address: Column) -> Column:
    """The first six digits that do not start with zero, else the first five."""
    a = F.coalesce(address, F.lit(""))
    six = F.regexp_extract(a, r"\b([1-9][0-9]{5})\b", 1)
    return F.when(six != "", six).otherwise(F.regexp_extract(a, r"\b([0-9]{5})\b", 1))


def postal_code_five_first(address: Column) -> Column:
    """The first five digits (with four more or not), else the first six."""
    a = F.coalesce(address, F.lit(""))
    five = F.regexp_extract(a, r"\b([0-9]{5})(?:-[0-9]{4})?\b", 1)
    return F.when(five != "", five).otherwise(F.regexp_extract(a, r"\b([0-9]{6})\b", 1))


def postal_code_any(address: Column) -> Column:
    return F.regexp_extract(F.coalesce(address, F.lit("")), r"\b([0-9]{5,6})\b", 1)


def postal_code_last(address: Column) -> Column:
    """The last five or six digits in a row."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(r"\b([0-9]{5,6})\b"), F.lit(1)), F.lit(-1)), F.lit(""))


def postal_code_by_country(address: Column, country: Column, house: Column) -> Column:
    """The last code of the country's form, unless it is the house number."""
    a = F.trim(F.coalesce(address, F.lit("")))
    six = F.regexp_extract_all(a, F.lit(r"\b([1-9][0-9]{5})\b"), F.lit(1))
    five = F.regexp_extract_all(a, F.lit(r"\b([0-9]{5})\b"), F.lit(1))
    code = F.coalesce(F.try_element_at(F.when(country == "India", six).otherwise(five), F.lit(-1)), F.lit(""))
    return F.when(code == house, F.lit("")).otherwise(code)


def address_tokens(normal: Column, stop: tuple[str, ...] = fixed.ADDRESS_STOP_V3) -> Column:
    """Distinct words of more than one character without the stop words, sorted."""
    words = F.filter(F.split(normal, r"\s+"), lambda w: F.length(w) > 1)
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, stop))))


def raw_tokens(address: Column) -> Column:
    """Distinct words of the raw address in lower case, sorted."""
    low = F.lower(F.coalesce(address, F.lit("")))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))))


def city(address: Column) -> Column:
    """The last part but one between commas."""
    parts = F.split(F.coalesce(address, F.lit("")), ",")
    return F.lower(F.trim(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))))


def state_part(address: Column) -> Column:
    """The last part between commas."""
    return F.lower(F.trim(F.element_at(F.split(F.coalesce(address, F.lit("")), ","), -1)))


def _first(address: Column, names: dict[str, str], strict: bool) -> Column:
    """The state that the address names; without a name, the least code among its words."""
    order = list(names.items()) if strict else sorted(names.items(), key=lambda x: (-len(x[0]), x[0]))
    out = F.when(F.lit(False), F.lit(""))
    for name, code in order:
        out = out.when(address.contains(name) if strict else address.rlike(rf"\b{name}\b"), F.lit(code))
    words = F.regexp_extract_all(address, F.lit(r"\b([a-z]{2,})\b"), F.lit(1))
    codes = F.array_intersect(words, F.array(*map(F.lit, sorted(set(names.values())))))
    return out.otherwise(F.coalesce(F.array_min(codes), F.lit("")))


def state(address: Column, country: Column, strict: bool = False) -> Column:
    """A state's code for addresses of the US and India. Longer names first and whole words;
    ``strict`` takes names in list order and inside words. Several codes: the least."""
    low = F.lower(F.coalesce(address, F.lit("")))
    return F.when(country == "US", _first(low, fixed.US_STATES, strict)).when(country == "India", _first(low, fixed.INDIA_STATES, strict)).otherwise(F.lit(""))


def rule_address(normal: Column, country: Column) -> Column:
    """The rule engine's reading of an address in lower-case ASCII: hn, tokens, city, nums and state."""
    st = F.lit("")
    for which, names in (("US", fixed.US_STATES), ("India", fixed.INDIA_STATES)):
        found = F.when(F.lit(False), F.lit(""))
        for name, code in names.items():
            found = found.when(normal.rlike(rf"\b{name}\b|\b{code}\b"), F.lit(code))
        st = F.when(country == which, F.coalesce(found, F.lit(""))).otherwise(st)
    one = _zeros(F.regexp_extract(normal, rf"\b(?:{fixed.NUMBER_WORDS})\s*([a-z0-9/\-]+)", 1))
    two = _zeros(F.regexp_extract(normal, r"\b([0-9]+[a-z0-9_/\-]+)", 1))
    three = _zeros(F.regexp_extract(normal, r"\b0*([0-9]+[a-z]?)\b", 1))
    hn = F.when(one != "", one).when(two != "", two).otherwise(three)
    parts = F.filter(F.transform(F.split(normal, ","), F.trim), lambda p: p != "")
    place = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(1)), F.lit(""))
    full = _rewrites(fixed.STREET_RULES).col(normal)
    words = F.filter(F.split(NOT_WORD_ASCII.col(full), r"\s+"), lambda w: F.length(w) > 1)
    stop = F.concat(F.array(*map(F.lit, fixed.ADDRESS_STOP_RULES)), F.array(hn, st))
    nums = F.transform(F.regexp_extract_all(full, F.lit(r"\b0*([0-9]+)\b"), F.lit(1)), _zeros)
    return F.struct(
        hn.alias("hn"),
        F.array_sort(F.array_except(words, stop)).alias("tokens"),
        F.trim(F.regexp_replace(place, r"[^a-zA-Z0-9_\s]", "")).alias("city"),
        F.array_sort(F.array_distinct(F.filter(nums, lambda x: x != ""))).alias("nums"),
        st.alias("state"),
    )
