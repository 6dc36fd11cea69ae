"""Roles of an event from a dependency parse: agent, evaluee, condition and time of its trigger.

A parser is any callable that takes sentences and returns each one's tokens; no model is shipped.  Roles are
read off the tree: every token is walked up once, which gives the tokens under each of its ancestors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lemmas of triggers and of those concerned, words that open conditions and times, edges walked at most.
EVENT_LEMMAS = {"impose", "terminate", "rescind", "suspend", "punish", "discipline", "reward"}
EVALUEE_LEMMAS = {"client", "claimant"}
CONDITION_MARKERS = {"if", "when", "unless"}
TIME_PREPOSITIONS = {"after", "before", "during", "from", "on", "since", "through", "until"}
MOST_EDGES = 12
ROLES = "map<string, struct<text: string, relation: string, head: string, start: int, end: int>>"


@dataclass(frozen=True)
class Token:
    """A token of a parse: its text and place, lemma, part of speech, relation to the token ``head`` (itself at the root)."""

    text: str
    start: int
    lemma: str
    pos: str
    relation: str
    head: int
    entity: str = ""

    @property
    def end(self) -> int:
        return self.start + len(self.text)

    @property
    def mark(self) -> bool:
        return not any(c.isalnum() for c in self.text)


Parser = Callable[[list[str]], list[list[Token]]]


def _paths(tokens: list[Token]) -> list[list[int]]:
    """From each token up to its root, the token itself first."""
    out = []
    for k in range(len(tokens)):
        path = [k]
        while (up := tokens[path[-1]].head) != path[-1] and up not in path:
            path.append(up)
        out.append(path)
    return out


def trigger_token(tokens: list[Token], start: int, end: int) -> int | None:
    """The last token in a stretch of text that is a trigger by its lemma, else the last verb there."""
    here = [k for k, t in enumerate(tokens) if t.start < end and t.end > start]
    named = [k for k in here if tokens[k].lemma.lower() in EVENT_LEMMAS]
    verbs = [k for k in here if tokens[k].pos in ("VERB", "AUX")]
    return (named or verbs or [None])[-1]


def roles(sentence: str, tokens: list[Token], start: int, end: int) -> dict[str, dict]:
    """The roles found around the trigger at ``start`` to ``end``; none where no token is the trigger."""
    trigger = trigger_token(tokens, start, end)
    if trigger is None:
        return {}
    paths = _paths(tokens)
    under: dict[int, list[int]] = {}
    for k, path in enumerate(paths):
        for up in path:
            under.setdefault(up, []).append(k)
    children = lambda of, relations: [k for k, t in enumerate(tokens) if t.head == of and k != of and t.relation in relations]
    word = lambda k: tokens[k].text.lower()

    def span(k: int, relation: str) -> dict:
        held = under[k]
        while len(held) > 1 and tokens[held[-1]].mark:
            held = held[:-1]
        a, b = tokens[held[0]].start, tokens[held[-1]].end
        return {"text": sentence[a:b], "relation": relation, "head": tokens[trigger].text, "start": a, "end": b}

    found: dict[str, dict] = {}
    passive = bool(children(trigger, ("auxpass", "nsubjpass")))
    subjects = [] if passive else children(trigger, ("nsubj", "csubj"))
    by = [k for k in children(trigger, ("agent", "prep")) if tokens[k].relation == "agent" or word(k) == "by"]
    objects = [o for k in by for o in children(k, ("pobj", "obj"))[:1]]
    if subjects:
        found["agent"] = span(subjects[0], "active_subject")
    elif objects:
        found["agent"] = span(objects[0], "passive_agent")
    concerned = [(paths[k].index(trigger), k) for k, t in enumerate(tokens) if t.lemma.lower() in EVALUEE_LEMMAS and trigger in paths[k][:MOST_EDGES]]
    if concerned:
        nearest = min(concerned)[1]
        found["evaluee"] = span(nearest, f"{tokens[nearest].relation}_linked_to_trigger")
    for clause in children(trigger, ("advcl",)):
        markers = sorted(word(k) for k in under[clause] if tokens[k].relation in ("mark", "advmod") and word(k) in CONDITION_MARKERS)
        if markers:
            made = span(clause, f"conditional_advcl:{markers[0]}")
            text = made["text"]
            found["condition"] = made | {"text": (text[len(markers[0]) + 1 :] if text.lower().startswith(markers[0] + " ") else text).strip(" ,")}
            break
    times = [(k, f"temporal_prep:{word(k)}") for k in children(trigger, ("prep",)) if word(k) in TIME_PREPOSITIONS]
    times += [(k, f"temporal_{tokens[k].relation}") for k in children(trigger, ("npadvmod", "advmod")) if tokens[k].entity in ("DATE", "TIME")]
    if times:
        found["time"] = span(*times[0])
    return found


def roles_column(sentence: Column, start: Column, end: Column, parser: Parser) -> Column:
    """The roles of each sentence's trigger as a map by role, parsed in Arrow batches; null without trigger."""

    def run(sentences: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out: list[dict | None] = [None] * len(sentences)
        asked = [k for k, (s, a) in enumerate(zip(sentences, starts, strict=True)) if s is not None and not pd.isna(a)]
        for k, tokens in zip(asked, parser([sentences.iloc[k] for k in asked]) if asked else [], strict=True):
            out[k] = roles(sentences.iloc[k], tokens, int(starts.iloc[k]), int(ends.iloc[k]))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, ROLES)(sentence, start, end)
