"""Licence scan: a trained paragraph classifier in DataFrame expressions.

A text's lines are its paragraphs. Those that hold an anchor word get the sum of the weights of their
n-grams (sparse logistic regression, see license_model), whose softmax gives the family or the calibrated
unknown class. The classifier identifies: a family that is not likelier than the unknown class, or whose
probability stays below the minimum when the other licences found there are left aside, is no result,
whatever its templates say. The templates only confirm: the paragraph must contain most word pairs of one
of the family's, and for a further family of the same line most of the pairs that only its templates have.

A notice may be broken into lines. A line without a family of its own, but made up of the word pairs of a
family's templates, is read with the words around it, as many as the longest template has on either side,
blank lines or not; these words are a paragraph that the classifier judges by the same rule. To confirm
its family they must contain most pairs of a template and most of its pairs that only this family has,
or (a notice cut short) be mostly part of one template.

Everything is one projection: no shuffle, no Python on the executors; the model is a constant of the plan,
of bounded size (at most the n-grams of the templates).

Defined results: a null or empty text has no paragraph and no licence; paragraphs of any length are read
whole; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_model import ANCHORS, NGRAM, UNKNOWN, LicenseModel, trained
from .shared import table

#: Least probability of a family (of 16 classes; it must be the likeliest), and least share of a template's word pairs that must be there.
MIN_PROBABILITY, MIN_COVER = 0.3, 0.6
#: A template of fewer word pairs (a heading) must make up that share of the line, too.
SHORT = 3
#: So many word pairs of a template must be there where the notice is cut short.
MIN_PART = 8


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _constant(value, schema: str) -> Column:
    """One literal of the plan, as a tree of literals takes long to analyse."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _windows(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces; none where there are fewer words."""
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def logits_of(words: Column, model: LicenseModel) -> Column:
    vocabulary = _constant(model.weights, "map<string, array<double>>")
    known = F.map_keys(vocabulary)
    grams = F.flatten(F.array(*[_windows(words, n) for n in range(1, NGRAM + 1)]))
    hits = F.array_intersect(grams, known)
    bias = F.array(*[F.lit(v) for v in model.bias])
    return F.aggregate(hits, bias, lambda acc, g: F.zip_with(acc, F.element_at(vocabulary, g), lambda a, b: a + b))


def _total(logits: Column) -> Column:
    """Sum of the exponentials, the largest as 1."""
    return F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - F.array_max(logits)))


def _alone(template: Column, hits: Column, pairs: Column) -> Column:
    """Whether a template is long enough to tell by itself, or makes up the line."""
    return (F.size(template) >= SHORT) | (hits >= MIN_COVER * F.size(F.array_distinct(pairs)))


def _decided(logits: Column, pairs: Column, model: LicenseModel) -> Column:
    """Struct (family, probability, cover) of the best class."""
    family = F.element_at(_strings(model.classes), F.array_position(logits, F.array_max(logits)).cast("int"))
    references = _constant(model.references, "map<string, array<array<string>>>")
    cover = F.array_max(F.transform(F.element_at(references, family), lambda t: bound(F.size(F.array_intersect(t, pairs)), lambda hits: F.when(_alone(t, hits, pairs), hits / F.size(t)))))
    return F.struct(family.alias("family"), (1 / _total(logits)).alias("probability"), F.coalesce(cover, F.lit(0.0)).alias("cover"))


def families_of(model: LicenseModel) -> Column:
    """Array of (family, at, all, own, templates (all, own)), all and own being word pairs."""
    rows = []
    for name, texts in model.references.items():
        own = model.own_pairs(name)
        templates = [{"all": t, "own": [p for p in t if p in own]} for t in texts if own & set(t)]
        rows.append({"family": name, "at": model.classes.index(name), "all": sorted({p for t in texts for p in t}), "own": sorted(own), "templates": templates})
    return _constant(rows, "array<struct<family: string, at: int, all: array<string>, own: array<string>, templates: array<struct<all: array<string>, own: array<string>>>>>")


def _shown(families: Column, pairs: Column, part: bool) -> Column:
    """(family, at, cover) of the families that the pairs tell of by a template's own pairs; part: or by a part of a template."""

    def cover(t: Column) -> Column:
        hits, own = F.size(F.array_intersect(t["all"], pairs)), F.size(F.array_intersect(t["own"], pairs))
        whole = F.when(_alone(t["all"], hits, pairs) & (own >= MIN_COVER * F.size(t["own"])) & (hits >= MIN_COVER * F.size(t["all"])), hits / F.size(t["all"]))
        return F.coalesce(whole, F.when((own > 0) & (hits >= MIN_PART) & (hits >= MIN_COVER * F.size(F.array_distinct(pairs))), hits / F.size(t["all"]))) if part else whole

    near = F.filter(families, lambda f: F.arrays_overlap(f["own"], pairs))
    covers = F.transform(near, lambda f: F.struct(f["family"].alias("family"), f["at"].alias("at"), F.array_max(F.transform(f["templates"], cover)).alias("cover")))
    return F.filter(covers, lambda f: f["cover"].isNotNull())


def _rated(shown: Column, others: Column, logits: Column) -> Column:
    """(family, probability, cover): the probability if the other families found there (shown and others) are left aside."""
    weight = lambda at: F.exp(F.element_at(logits, at + 1) - F.array_max(logits))
    known = F.array_union(F.transform(shown, lambda f: f["at"]), others)
    aside = lambda f: F.aggregate(F.filter(known, lambda at: at != f["at"]), F.lit(0.0), lambda acc, at: acc + weight(at))
    return F.transform(shown, lambda f: F.struct(f["family"].alias("family"), F.least(F.lit(1.0), weight(f["at"]) / F.greatest(weight(f["at"]), _total(logits) - aside(f))).alias("probability"), f["cover"].alias("cover")))


def _identified(shown: Column, others: Column, logits: Column, model: LicenseModel) -> Column:
    """Those of the confirmed families that the classifier names: likelier than the unknown class, and probable enough."""
    least = F.element_at(logits, model.classes.index(UNKNOWN) + 1)
    above = F.filter(shown, lambda f: F.element_at(logits, f["at"] + 1) > least)
    return F.filter(bound(above, lambda some: _rated(some, others, logits)), lambda f: f["probability"] >= MIN_PROBABILITY)


def classified(words: Column, model: LicenseModel) -> Column:
    """Array of (family, probability, cover) of a line's words: the licences that it names."""
    none = F.array().cast("array<struct<family: string, probability: double, cover: double>>")

    def judged(x: Column) -> Column:
        return bound(F.struct(x["z"].alias("z"), x["pairs"].alias("pairs"), _decided(x["z"], x["pairs"], model).alias("c")), named)

    def named(x: Column) -> Column:
        first = x["c"]
        sure = (first["probability"] >= MIN_PROBABILITY) & (first["cover"] >= MIN_COVER)
        best = (F.array_position(x["z"], F.array_max(x["z"])) - 1).cast("int")
        rest = bound(_shown(F.filter(families_of(model), lambda f: ~sure | (f["family"] != first["family"])), x["pairs"], False), lambda s: _identified(s, F.when(sure, F.array(best)).otherwise(F.array().cast("array<int>")), x["z"], model))
        return F.when(first["family"] == UNKNOWN, none).otherwise(F.concat(F.when(sure, F.array(first)).otherwise(none), rest))

    return bound(F.struct(logits_of(words, model).alias("z"), _windows(words, 2).alias("pairs")), judged)


def broken(lines: Column, at: Column, model: LicenseModel) -> Column:
    """Array of (family, probability, cover) of the notices that go over several lines, the one at ``at`` (from 0) among them."""
    none = F.array().cast("array<struct<family: string, probability: double, cover: double>>")
    words = lines[at]["words"]
    ends = lambda some, n: F.flatten(F.transform(some, lambda p: F.slice(p["words"], F.greatest(F.lit(1), F.size(p["words"]) - n + 1), F.lit(n))))
    starts = lambda some, n: F.flatten(F.transform(some, lambda p: F.slice(p["words"], F.lit(1), F.lit(n))))

    def around(n: int) -> Column:
        """The line's words with n words before and after it; each line has one at least."""
        before = bound(ends(F.slice(lines, F.greatest(F.lit(1), at - n + 1), F.least(at, F.lit(n))), n), lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)))
        after = F.slice(starts(F.slice(lines, at + 2, F.lit(n)), n), F.lit(1), F.lit(n))
        return F.concat(before, words, after)

    def made_up(pairs: Column) -> Column:
        return F.filter(families_of(model), lambda f: F.size(F.array_intersect(f["all"], pairs)) >= F.greatest(F.lit(1.0), MIN_COVER * F.size(F.array_distinct(pairs))))

    def read(families: Column) -> Column:
        return F.when(F.size(families) == 0, none).otherwise(bound(around(model.longest), lambda w: bound(_shown(families, _windows(w, 2), True), lambda s: F.when(F.size(s) == 0, none).otherwise(bound(logits_of(w, model), lambda z: _identified(s, F.array().cast("array<int>"), z, model))))))

    return bound(bound(_windows(around(1), 2), made_up), read)


def scan_licenses(docs: DataFrame, text: str = "text", into: str = "licenses", model: LicenseModel | None = None) -> DataFrame:
    """docs with a column ``into``: an array of (paragraph, family, probability, cover) of the paragraphs with a licence.

    paragraph is the line's number, from 0; a line with several licences has an entry for each. A column that
    is named ``into`` already is replaced.
    """
    model = model or trained()
    split = F.transform(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n"), lambda line, i: F.struct(i.alias("paragraph"), words_of(line).alias("words")))

    def scanned(lines: Column) -> Column:
        numbered = F.transform(lines, lambda p, i: F.struct(p["paragraph"].alias("paragraph"), i.alias("at"), p["words"].alias("words")))
        anchored = F.filter(numbered, lambda p: F.arrays_overlap(p["words"], _strings(ANCHORS)))
        alone = lambda p: bound(classified(p["words"], model), lambda c: F.when(F.size(c) > 0, c).otherwise(broken(lines, p["at"], model)))
        return F.flatten(F.transform(anchored, lambda p: F.transform(alone(p), lambda c: F.struct(p["paragraph"].alias("paragraph"), c["family"].alias("family"), c["probability"].alias("probability"), c["cover"].alias("cover")))))

    return docs.withColumn(into, bound(F.filter(split, lambda p: p["words"][0] != ""), scanned))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of lines with a licence, the families in order, the least probability among the entries."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    families = F.array_sort(F.array_distinct(F.col("licenses.family")))
    return found.select(
        "doc_id",
        F.size(F.array_distinct(F.col("licenses.paragraph"))).cast("long").alias("n_license_lines"),
        F.array_join(families, ",").alias("families"),
        F.array_min("licenses.probability").alias("min_probability"),
    )
