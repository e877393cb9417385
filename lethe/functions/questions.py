"""Questions from part-of-speech tags, as Column expressions.

Tags, tokens and lemmas belong to the relation, entity types to the object;
both come from annotation tables with one row per distinct text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag names of the two annotators.
PERSON, PLACE, DATE = "PERSON", "GPE", "DATE"
FIRST_TAGGER_TYPES = {"PER": PERSON, "LOC": PLACE}
NOUN_TAGS = ("NN", "NNP", "NNPS", "NNS")
VERB_TAGS = ("VBN", "VBD", "VB", "VBZ")


def agreed_type(ner1: Column, ner2: Column) -> Column:
    """struct(keep, type): the object's type, where both annotators allow one.

    The first annotator only counts for persons and places; there the second
    must agree, and where it is silent the second may claim neither.
    """
    first = F.lit(None).cast("string")
    for tag, name in FIRST_TAGGER_TYPES.items():
        first = F.when(ner1 == tag, name).otherwise(first)
    second_is_strict = F.coalesce(ner2.isin(PERSON, PLACE), F.lit(False))
    keep = F.when(first.isNotNull(), first.eqNullSafe(ner2)).otherwise(~second_is_strict)
    return F.struct(keep.alias("keep"), F.when(keep, ner2).alias("type"))


def question_word(object_type: Column) -> Column:
    return F.when(object_type == PERSON, "Who").when(object_type == DATE, "When").otherwise("What")


def relation_form(tags: Column) -> Column:
    """Which of the four question shapes a relation allows; null for none."""
    first, last = F.get(tags, F.lit(0)), F.element_at(tags, -1)
    any_noun = F.exists(tags, lambda t: t.isin(*NOUN_TAGS))
    ends_in_noun = last.isin(*NOUN_TAGS)
    ends_in_preposition = last == "IN"
    return (
        F.when(ends_in_preposition & ~first.isin(*VERB_TAGS), None)
        .when((first == "VBN") & ends_in_preposition & ~any_noun, "participle")
        .when((first == "VBD") & ~ends_in_noun, "past")
        .when(first.isin("VB", "VBZ") & ~ends_in_noun, "present")
        .when(last.isin("NN", "NNP") & ~first.isin("VB", "VBZ", "VBD"), "noun")
    )


def base_verbs(tokens: Column, tags: Column, lemmas: Column, tag: str) -> Column:
    """The relation with verbs of one tense put in their base form."""
    words = F.transform(
        F.arrays_zip(tokens.alias("token"), tags.alias("tag"), lemmas.alias("lemma")),
        lambda t: F.when(t["tag"] == tag, t["lemma"]).otherwise(t["token"]),
    )
    return F.array_join(words, " ")


def forward_question(form: Column, word: Column, subject: Column, relation: Column, past: Column, present: Column) -> Column:
    def ask(pattern: str, *parts: Column) -> Column:
        return F.format_string(pattern, word, *parts)

    return (
        F.when(form == "participle", ask("%s was %s %s?", subject, relation))
        .when(form == "past", ask("%s did %s %s?", subject, past))
        .when(form == "present", ask("%s does %s %s?", subject, present))
        .when(form == "noun", ask("%s is the %s of %s?", relation, subject))
    )


def reverse_question(form: Column, word: Column, object_type: Column, subject: Column, relation: Column, topic: Column) -> Column:
    """The swapped shapes; `topic` is the kind of thing asked for, or null."""
    kind = F.when(topic.isNotNull() & (topic != "revolution"), topic).otherwise("revolution or war")
    which = F.concat(F.lit("Which "), kind)
    asked = F.when(object_type == PERSON, word).otherwise(which)
    possessive = F.when(topic == "human", F.concat(word, F.lit("se"))).otherwise(F.concat(which, F.lit("'s")))
    return (
        F.when(form == "participle", F.format_string("%s was %s %s?", asked, relation, subject))
        .when(form.isin("past", "present"), F.format_string("%s %s %s?", asked, relation, subject))
        .when(form == "noun", F.format_string("%s %s is %s?", possessive, relation, subject))
    )
