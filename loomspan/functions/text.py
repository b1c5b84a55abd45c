"""Text functions as column expressions: slugs, terms, sentence splits, gates, coercions, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that never begin or end a term.
STOP_WORDS = (
    "a an the this that these those it its it’s it´s in on at to for with from by as of and or but if when while where "
    "which who whom whose what how why not no we you they he she him her them his our their your my is are was were be "
    "been being do does did have has had will would can could should may might each every any all both few many much "
    "more most other some such than too very under within without because however although though since good small "
    "large new first second third one two three finally neither either also just only even still yet already often "
    "never always usually sometimes wider narrower higher lower larger smaller"
).split()
# Verbs that make a description assessable.
VERBS = (
    "is are was were be been define defines defined state states stated describe describes described explain explains "
    "explained identify identifies identify calculate calculates calculated compute compare compares contrast "
    "distinguish interpret apply applies use uses demonstrate illustrate give gives list name recall recognize solve "
    "distinguish predict infer summarize discuss contrast outline show shows determine derive prove construct draw"
).split()
# Levels and knowledge types.
BLOOM = ("remember", "understand", "apply", "analyze", "evaluate", "create")
KNOWLEDGE = ("factual", "conceptual", "procedural", "metacognitive")
#: Capitalised phrases of one to three words, with Unicode word boundaries.
TERM = r"(?U)\b[A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){0,2}\b"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"


def slug(label: Column) -> Column:
    """Kebab case of ASCII letters and digits; 'item' where nothing is left."""
    s = F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", "item").otherwise(s)


def numbered(slug_col: Column, nth: Column) -> Column:
    """The n-th holder of a slug: the first keeps it, later ones get -n."""
    return F.when(nth == 1, slug_col).otherwise(F.concat(slug_col, F.lit("-"), nth.cast("string")))


def terms(text: Column) -> Column:
    """Capitalised phrases in order, without function words at their ends, of three characters or more."""
    stop = F.array(*map(F.lit, STOP_WORDS))

    def trimmed(phrase: Column) -> Column:
        words = F.split(phrase, r"(?U)\s+")
        content = F.transform(words, lambda w: ~F.array_contains(stop, F.lower(w)))
        first, last = F.array_position(content, True), F.size(words) - F.array_position(F.reverse(content), True) + 1
        return F.when(first > 0, F.array_join(F.slice(words, first.cast("int"), (last - first + 1).cast("int")), " "))

    found = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), trimmed)
    return F.filter(found, lambda t: F.length(t) >= 3)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def gate(label: Column, description: Column, flags: dict[str, Column] | None = None) -> Column:
    """struct(ok, reason) of an item: the first rule that fails gives the reason."""
    label, description = F.coalesce(label, F.lit("")), F.coalesce(description, F.lit(""))
    verbs = F.array(*map(F.lit, sorted(set(VERBS))))
    size = lambda c: F.length(c).cast("string")
    reason = F.when(~F.length(label).between(3, 120), F.concat(F.lit("label length "), size(label), F.lit(" outside 3..120")))
    reason = reason.when(~F.length(description).between(10, 2000), F.concat(F.lit("description length "), size(description), F.lit(" outside 10..2000")))
    reason = reason.when(~F.arrays_overlap(F.regexp_extract_all(F.lower(description), F.lit("[a-z]+"), F.lit(0)), verbs), "description has no assessable verb")
    for name, flag in (flags or {}).items():
        reason = reason.when(~flag, f"oracle flags {name}=false")
    reason = reason.otherwise("pass")
    return F.struct((reason == "pass").alias("ok"), reason.alias("reason"))


def split_item(item_id: Column, description: Column) -> Column:
    """Array of (id, description): the first sentence and the rest, or nothing where there is one sentence."""
    parts = sentences(description)
    first = F.struct(F.concat(item_id, F.lit("-a")).alias("id"), F.element_at(parts, 1).alias("description"))
    rest = F.struct(F.concat(item_id, F.lit("-b")).alias("id"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " ").alias("description"))
    return F.when(F.size(parts) >= 2, F.array(first, rest)).otherwise(F.array().cast("array<struct<id: string, description: string>>"))


def coerce_level(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*BLOOM), v).otherwise("understand")


def coerce_knowledge(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*KNOWLEDGE), v).otherwise("conceptual")


def coerce_depth(value: Column) -> Column:
    """An integer from 1 to 4, else 1; a fraction is cut off."""
    text = F.trim(value.cast("string"))
    n = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.coalesce(F.when(n.between(1, 4), n), F.lit(1))


def unfenced(text: Column) -> Column:
    """A reply without its code fence."""
    return F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\n?|\n?```$", "")


def parse_reply(text: Column) -> Column:
    """A reply as VARIANT; null where it is no JSON."""
    return F.try_parse_json(unfenced(text))


def response_value(raw: Column) -> Column:
    """A JSON literal, or else the raw string, as VARIANT."""
    return F.coalesce(F.try_parse_json(raw), raw.cast("variant"))


def prompt(instruction: str, *payload: Column) -> Column:
    """An instruction followed by its payload as JSON, one line each."""
    return F.concat_ws("\n", F.lit(instruction), *(F.to_json(p) for p in payload))
