"""Names, addresses, published figures and digests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: risk labels from least to most, and the weight of each class of difficulty
RISKS = ["low", "moderate", "considerable", "high", "extreme"]
CLASS_WEIGHTS = {1: 1.0, 2: 2.0, 3: 4.0, 4: 8.0, 5: 16.0}
# fixed values: spellings of one name
ALIASES = (("mt.", "mount"), ("mt ", "mount "), ("mount of the holy cross", "holy cross"), ("mount evans", "mount blue sky"))

# fixed values: what is left out of names
DROPPED = (r"\([^)]*\)", r"\bstandard route\b", r"\bthe\b")
# fixed values: words before a start, words before a way, and labels that lead a figure
START_WORDS = r"(?i)^(?:from|starting at|starting near|if you start at|if you start near)\s+"
WAY_WORDS = r"(?i)^(?:via|if you descend)\s+"
LEADING_WORDS = r"(?:from|with)"
# fixed values: attributes that hold addresses, and endings of the addresses that count
LINK_ATTRIBUTES = r"(?:href|data-href|data-url|data-download|action)"
LINK_ENDINGS = r"(?:php|gpx)"


def _terms(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), " ")


def normal_name(text: Column) -> Column:
    """A name's words in lower case: aliases resolved, parentheses, 'standard route' and 'the'
    left out.  Null stays null."""
    text = F.lower(text)
    for old, new in ALIASES:
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern in DROPPED:
        text = F.regexp_replace(text, pattern, " ")
    return _terms(text)


def normal_start(text: Column) -> Column:
    """A starting point's words in lower case, 'trailhead' as 'th', parentheses' content kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\btrailhead\b", "th"), "[^a-z0-9]+", " "))


def unescaped(text: Column) -> Column:
    """The entities that occur in addresses decoded."""
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def canonical_url(url: Column, host: str) -> Column:
    """The address of a page of ``host`` in one spelling, null for any other address.

    Relative addresses belong to the host.  Kept are https addresses of the host, with or
    without www, without user and with no port but 443; the fragment is dropped.
    """
    url = unescaped(F.trim(url))
    url = F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), url).otherwise(F.concat(F.lit(f"https://www.{host}/"), F.regexp_replace(url, "^/+", "")))
    parts = rf"(?i)^https://(?:www\.)?{host.replace('.', chr(92) + '.')}(?::443)?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$"
    path = F.regexp_extract(url, parts, 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, parts, 2)
    return F.when(url.rlike(parts), F.concat(F.lit(f"https://www.{host}"), path, F.when(query == "?", "").otherwise(query)))


def page_key(url: Column, page: str = "route.php", parameter: str = "route") -> Column:
    """The parameter of a canonical address of ``page``; null unless it stands there exactly
    once and consists of letters, digits, _ and -."""
    stem = page.replace(".", r"\.")
    value = F.regexp_extract(url, rf"/{stem}\?(?:[^#]*&)?{parameter}=([a-zA-Z0-9_-]+)(?:&|#|$)", 1)
    once = F.regexp_count(url, F.lit(rf"[?&]{parameter}=")) == 1
    return F.when((value != "") & once, value)


def figures(text: Column, label: str, unit: str, ends: list[str]) -> Column:
    """All published figures after a label, as array<struct<value, start_label, scope_note>>.

    The section runs from the label to the next of the labels ``ends``.  'From X: n' and 'With
    X: n' give n with label X; otherwise every number before the unit counts, with the words
    after it as its label if they name a start, as a note if not.  The choice is left to the caller.
    """
    stop = "|".join(ends)
    section = F.regexp_extract(text, rf"(?is){label}\s+(.*?)(?={stop}|$)", 1)
    number = r"([\d,]+(?:\.\d+)?)"
    value = lambda s: F.regexp_replace(s, ",", "").try_cast("double")
    led = section.rlike(rf"(?i)^{LEADING_WORDS}\s+") & section.rlike(rf"(?i){unit}")
    led_labels = F.regexp_extract_all(section, F.lit(rf"(?i){LEADING_WORDS}\s+([^:]+):\s*{number}"), F.lit(1))
    led_values = F.regexp_extract_all(section, F.lit(rf"(?i){LEADING_WORDS}\s+([^:]+):\s*{number}"), F.lit(2))
    led_all = F.zip_with(led_values, led_labels, lambda v, n: F.struct(value(v).alias("value"), F.trim(n).alias("start_label"), F.lit(None).cast("string").alias("scope_note")))
    values = F.regexp_extract_all(section, F.lit(rf"(?i){number}\s*{unit}"), F.lit(1))
    tails = F.split(section, rf"(?i)[\d,]+(?:\.\d+)?\s*{unit}")
    tails = F.slice(tails, 2, F.greatest(F.size(tails) - 1, F.lit(0)))

    def one(v: Column, tail: Column) -> Column:
        tail = F.regexp_replace(F.regexp_replace(tail, r"^[ :;,()-]+", ""), r"[ :;,()-]+$", "")
        name = F.when(tail.rlike(WAY_WORDS), tail).when(tail.rlike(START_WORDS), F.regexp_replace(tail, START_WORDS, "")).otherwise("")
        return F.struct(value(v).alias("value"), name.alias("start_label"), F.when((name == "") & (tail != ""), tail).alias("scope_note"))

    return F.when(led, led_all).otherwise(F.zip_with(values, tails, one))


def selected_figure(candidates: Column, start: Column) -> Column:
    """The one figure that holds for a start: of several the one whose label names it; a single
    one unless its label names another.  Null where none or more than one does."""
    wanted = normal_start(start)
    match = F.filter(candidates, lambda c: (c["start_label"] != "") & (normal_start(c["start_label"]) == wanted))
    single = candidates[0]
    other = (single["start_label"] != "") & (F.coalesce(start, F.lit("")) != "") & (normal_start(single["start_label"]) != wanted)
    return F.when(F.size(candidates) > 1, F.when(F.size(match) == 1, match[0]["value"])).when((F.size(candidates) == 1) & ~other, single["value"])


def links(html: Column, host: str) -> Column:
    """The distinct canonical page and track addresses that a page names, sorted: attributes
    and quoted strings ending in .php or .gpx; nothing is put together from parts."""
    named = F.regexp_extract_all(html, F.lit(rf"(?is){LINK_ATTRIBUTES}\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    quoted = F.regexp_extract_all(html, F.lit(rf"(?is)[\"']([^\"'\r\n<>]+\.{LINK_ENDINGS}(?:\?[^\"'\r\n<>]*)?)[\"']"), F.lit(1))
    values = F.transform(F.concat(named, quoted), lambda v: F.replace(v, F.lit("\\/"), F.lit("/")))
    good = F.filter(values, lambda v: ~v.rlike(r"(?i)^(javascript:|#|mailto:)") & v.rlike(rf"(?i)\.{LINK_ENDINGS}(\?|$)") & ~v.rlike(r"[ {}<>]"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(good, lambda v: canonical_url(v, host)))))


def risk_level(label: Column) -> Column:
    """0 to 4 for a risk label in any case and padding, null for anything else."""
    at = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.lower(F.trim(label)))
    return F.when(at > 0, at - 1).cast("int")


def class_weight(number: Column) -> Column:
    """The weight of a class of difficulty, null for an unknown class."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_WEIGHTS.items() for x in kv]), number.cast("int"))


def page_fields(text: Column) -> dict[str, Column]:
    """Class, risks, length and gain stated in a text; null where it states none."""
    found = lambda pattern: F.nullif(F.regexp_extract(text, rf"(?i){pattern}", 1), F.lit(""))
    fields = {"yds_class": found(r"\bclass\s+(\d)").cast("int")}
    for name, label in (("exposure", "exposure"), ("rockfall", "rockfall"), ("route_finding", "route[ -]finding"), ("commitment", "commitment")):
        fields[name] = F.lower(found(rf"\b{label}\s+(low|moderate|considerable|high|extreme)\b"))
    fields["length_mi"] = F.regexp_replace(found(r"\blength\s+([\d,]+(?:\.\d+)?)\s*mi"), ",", "").cast("double")
    fields["gain_ft"] = F.regexp_replace(found(r"\bgain\s+([\d,]+)\s*f"), ",", "").cast("double")
    return fields


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 as hex, from nested digests; the key must have 32 bytes at least."""
    import hashlib

    if len(key) < 32:
        raise ValueError("the key must have at least 32 bytes")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)
