"""Utterance classes from rule tables: ordered rules compiled to one expression, no join with the rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Rule:
    """Holds for a normalised text with ``min_hits`` of ``any_terms`` and none of ``none_terms``; mode as in hint_match."""

    label: str
    any_terms: tuple[str, ...]
    none_terms: tuple[str, ...] = field(default=())
    mode: str = "word"
    min_hits: int = 1
    delta: float = 0.0

    def holds(self, x: Column) -> Column:
        if self.min_hits == 1:
            out = T.any_hint(x, list(self.any_terms), self.mode)
        else:
            out = sum((T.hint_match(x, t, self.mode).cast("int") for t in self.any_terms), F.lit(0)) >= self.min_hits
        return out & ~T.any_hint(x, list(self.none_terms), self.mode) if self.none_terms else out


def rules_of(table: DataFrame, rule_set: str) -> list[Rule]:
    """The rules of one set, in order, from a rule table (rule_set, pos, label, match_mode, any_terms, none_terms, min_hits, delta): a small fixed table."""
    rows = table.where(F.col("rule_set") == rule_set).orderBy("pos").collect()
    return [Rule(r.label, tuple(r.any_terms or ()), tuple(r.none_terms or ()), r.match_mode or "word", r.min_hits or 1, r.delta or 0.0) for r in rows]


def first_label(x: Column, rules: list[Rule], default: str = "") -> Column:
    """Label of the first rule that holds."""
    out = F.lit(default)
    for r in reversed(rules):
        out = F.when(r.holds(x), r.label).otherwise(out)
    return out


def all_labels(x: Column, rules: list[Rule]) -> Column:
    """Labels of all rules that hold, in order, each once."""
    return F.array_distinct(F.filter(F.array(*[F.when(r.holds(x), r.label) for r in rules]), lambda t: t.isNotNull()))


def score(x: Column, rules: list[Rule]) -> Column:
    """Sum of the deltas of the rules that hold."""
    return sum((F.when(r.holds(x), F.lit(r.delta)).otherwise(0.0) for r in rules), F.lit(0.0))


def longest_hint(x: Column, hints: list[tuple[str, str]], default: str = "") -> Column:
    """Label of the longest (label, hint) that is contained; the first of equally long ones."""
    order = sorted(range(len(hints)), key=lambda k: (-len(hints[k][1]), k))
    return first_label(x, [Rule(hints[k][0], (hints[k][1],), mode="contains") for k in order], default)


def best_topic(x: Column, rules: list[Rule], default: str = "") -> Column:
    """The label with the most words of its terms in the text (delta is a bonus); the first of equals; the default without any."""
    points = [F.struct((sum((F.when(T.hint_match(x, t, r.mode), float(len(t.split()))).otherwise(0.0) for t in r.any_terms), F.lit(0.0))).alias("hits"), F.lit(-k).alias("pos"), F.lit(r.label).alias("label"), F.lit(r.delta).alias("bonus")) for k, r in enumerate(rules)]
    scored = F.transform(F.array(*points), lambda p: F.struct(F.when(p.hits > 0, p.hits + p.bonus).otherwise(0.0).alias("points"), p.pos.alias("pos"), p.label.alias("label")))
    best = F.array_max(scored)
    return F.when(best.points > 0, best.label).otherwise(default)


def _tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))


def _in(t: Column, words: tuple[str, ...]) -> Column:
    return t.isin(*words) if words else F.lit(False)


def person_like(x: Column, titles: tuple[str, ...], units: tuple[str, ...], asking: tuple[str, ...]) -> Column:
    """A title and a name: two to six tokens, no phrase that asks, the second token no unit, all but the first of letters only."""
    t = _tokens(x)
    return F.size(t).between(2, 6) & ~T.any_hint(x, list(asking)) & ~_in(F.get(t, F.lit(1)), units) & _in(F.get(t, F.lit(0)), titles) & F.forall(F.slice(t, 2, 6), lambda w: w.rlike("^[a-z]+$"))


def fragment_like(x: Column, terms: tuple[str, ...], asking: tuple[str, ...]) -> Column:
    """Two to five tokens, all of them listed terms, and no phrase that asks."""
    t = _tokens(x)
    return F.size(t).between(2, 5) & ~T.any_hint(x, list(asking)) & F.forall(t, lambda w: _in(w, terms))


def low_signal(x: Column, exact: tuple[str, ...], other: Column, titles: tuple[str, ...], units: tuple[str, ...], terms: tuple[str, ...], asking: tuple[str, ...], anchors: tuple[str, ...], short: tuple[str, ...]) -> Column:
    """Too little to answer: a listed utterance; or, if no ``other`` class applies, a person's name or a fragment alone, or one of the ``short`` utterances of three words at most without an anchor."""
    words = F.size(F.filter(F.split(x, " "), lambda t: t != ""))
    alone = person_like(x, titles, units, asking) | fragment_like(x, terms, asking) | ((words <= 3) & ~T.any_hint(x, list(anchors)) & x.isin(*short))
    return (x != "") & (x.isin(*exact) | (~other & alone))


def policy_class(x: Column, verbs: tuple[str, ...], targets: tuple[str, ...], rules: list[Rule]) -> Column:
    """``harmful_or_violent`` where a verb meets a target, else the first rule's label, else ''."""
    return F.when(both(x, verbs, targets), "harmful_or_violent").otherwise(first_label(x, rules))


@dataclass(frozen=True)
class Sensitive:
    """What marks a request for private data: phrases that are allowed, codes of groups and of persons, and what is asked about whom."""

    allowed: tuple[str, ...]
    hints: tuple[str, ...]
    group: str
    group_code: str
    person_code: str
    grades: tuple[str, ...]
    person_info: tuple[str, ...]
    group_info: tuple[str, ...]
    persons: tuple[str, ...]
    counts: tuple[str, ...]
    group_counts: tuple[str, ...]
    units: tuple[str, ...]


#: The codes of the classes.
PRIVATE_PERSON, PRIVATE_GROUP, GROUP_SCOPE = "student_private_info", "class_private_info", "class_scope_not_supported"


def sensitive_class(x: Column, s: Sensitive) -> Column:
    """The code of a request for private data, or ''. Hints come first, then codes of persons and groups, then combinations of scope and question."""
    has = lambda words: T.any_hint(x, list(words))
    group, person = x.contains(s.group), has(s.persons)
    return (
        F.when(has(s.allowed), "")
        .when(has(s.hints) & group & has(s.group_counts), GROUP_SCOPE)
        .when(has(s.hints) & group, PRIVATE_GROUP)
        .when(has(s.hints), PRIVATE_PERSON)
        .when(x.rlike(s.person_code), PRIVATE_PERSON)
        .when(x.rlike(s.group_code), PRIVATE_GROUP)
        .when(person & (has(s.grades) | has(s.person_info)), PRIVATE_PERSON)
        .when(group & person, PRIVATE_GROUP)
        .when(group & has(s.counts) & has(s.units), GROUP_SCOPE)
        .when(group & has(s.counts), PRIVATE_GROUP)
        .otherwise("")
    )


def reply_class(text: Column, x: Column, decline: tuple[str, ...], other: Column, questionish: tuple[str, ...], cues: tuple[str, ...]) -> Column:
    """``decline``, ``provide`` or ``other`` for a reply: questions, other classes and fewer than three words are ``other``; a cue or six words provide."""
    words = F.size(F.filter(F.split(x, " "), lambda t: t != ""))
    return (
        F.when(x == "", "other")
        .when(T.any_hint(x, list(decline)), "decline")
        .when(other | text.contains("?") | T.any_hint(x, list(questionish)) | (words < 3), "other")
        .when(T.any_hint(x, list(cues)) | (words >= 6), "provide")
        .otherwise("other")
    )


def both(x: Column, verbs: tuple[str, ...], targets: tuple[str, ...]) -> Column:
    """A token of each list occurs."""
    tokens = F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))
    return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in verbs])) & F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in targets]))


def out_of_scope(x: Column, classes: list[Column], scope: tuple[str, ...], common: tuple[str, ...]) -> Column:
    """No class applies, no scope hint occurs, and two content tokens at least remain."""
    listed = F.array(*[F.lit(t) for t in common])
    content = F.size(F.filter(F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~F.array_contains(listed, t)))
    out = ~T.any_hint(x, list(scope), "word") & (content >= 2)
    for c in classes:
        out = out & ~c
    return out


def family(classes: list[tuple[str, Column]], default: str = "general") -> Column:
    """The first class whose column holds."""
    out = F.lit(default)
    for name, c in reversed(classes):
        out = F.when(c, name).otherwise(out)
    return out


def expand(query: Column, x: Column, aliases: list[tuple[str, str]], limit: int = 8) -> Column:
    """The query, then the expansions of the aliases that its normal form holds, each once, joined by blanks."""
    extra = F.filter(F.array(*[F.when(T.hint_match(x, a, "word"), b) for a, b in aliases]), lambda t: t.isNotNull())
    return F.array_join(F.slice(F.array_distinct(F.concat(F.array(query), extra)), 1, limit), " ")


def followup(x: Column, left: Column, units: tuple[str, ...], stops: tuple[str, ...], empty: tuple[str, ...], hints: tuple[str, ...], anchors: tuple[str, ...], fields: tuple[str, ...], generic: tuple[str, ...]) -> Column:
    """The turn leans on the one before: context is ``left``, it names no unit of its own, and it has a hint, or no anchor and a field word or a generic form.

    A unit is named if one of ``units`` is followed by words, up to a phrase of ``stops``, that are not all ``empty``.
    """
    named = F.regexp_extract(x, rf"\b(?:{'|'.join(units)})\s+([a-z0-9][a-z0-9\s&.-]*)", 1)
    named = F.trim(F.regexp_extract(named, rf"^(.*?)(?:\b(?:{'|'.join(stops)})\b|$)", 1))
    own = F.size(F.filter(F.split(named, " "), lambda t: (t != "") & ~_in(t, empty))) > 0
    has = lambda words: T.any_hint(x, list(words))
    return (left > 0) & ~own & (has(hints) | (~has(anchors) & (has(fields) | x.isin(*generic))))
