"""Small inline tables that queries over text without a test table run on; the same rows in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POLICIES = [
    (1, "A 31 - Late report - Second notice disqualification (D31) is imposed unless the claimant has fewer than 420 insurable hours.\nWhen the evidence received supports that the disqualification be lifted, it is terminated on the Monday of the week after the review week."),
    (2, "After the call the agent does not impose a D18 on the claimant."),
    (3, "The D57 is terminated if the employer confirms the dates."),
    (4, "The system rescinds D18. No letter goes out. The agent imposes a written penalty (D64) on clients."),
    (5, "The client's disqualification was suspended by the regional office until Monday."),
    (6, "For that reason the system does not impose a D31 when the start lies between w/c 1204 and w/c 1240."),
    (7, "Keep a copy of every page on file."),
    (8, "A D33 must be imposed. The D33 cannot be imposed unless the system agrees. It is suspended."),
]
ACRONYMS = [
    (1, "Our AI group stores every NLP model in one DB, with an ETA for each."),
    (2, "Staff file a Request For Comment (RFC) first. Each RFC names its API."),
    (3, "Each node has one GPU (Graphics Processing Unit) and little RAM."),
    (4, "Ask the PM whether IT in the US sends the ETA. Payments go by Delayed Debit (DD) since May."),
    (5, None),
]
REPLIES = [
    (1, '{"relationship_type": "one_doc_included", "analysis": "Part of it."}'),
    (2, '```json\n{"relationship_type": "none_of_above", "analysis": "Apart."}\n```'),
    (3, "no json at all"),
    (4, '{"relationship_type": "same", "analysis": "Alike."}'),
    (5, '["semantically_identical"]'),
]
VERSES = [(1, "1 Samuel 3:4"), (2, "Song of Songs 1:12"), (3, "Preface"), (4, "Genesis 50:26 a"), (5, None)]
CONDITIONS = [
    (1, " the worker has fewer than 300 insurable hours,"), (2, "hours were not accumulated at least 12 insurable hours"), (3, "the file starts between w/c 15 and w/c  40"),
    (4, "the letter is late"), (5, None), (6, "BETWEEN W/C 1 AND W/C 2, fewer than 5 insurable hours"),
]
FRAMES = [
    ("Rewards_and_punishments", 1, ["Agent", "Evaluee", "Response_action", "Reason", "Time"], ["penalty.n", "punish.v", "discipline.v"]),
    ("Activity_stop", 2, ["Agent", "Activity", "Explanation", "Time"], ["terminate.v", "stop.v"]),
    ("Activity_pause", 3, ["Agent", "Activity", "Time"], ["suspend.v", "pause.v"]),
]

ELEMENTS = [
    ("Activity_stop", 11, "Agent", "Core", "The <b>one</b> who  stops."),
    ("Activity_stop", 12, "Activity", "Core", "What is stopped."),
    ("Activity_pause", 21, "Agent", "Core", "The one who pauses."),
    ("Activity_pause", 22, "Time", "Peripheral", None),
]
DEFINITIONS = [("Activity_stop", 2, "An <fen>Agent</fen> ends an <fen>Activity</fen>."), ("Activity_pause", 3, "A halt\nfor a time."), ("Empty_frame", 4, None)]
UNITS = [("Activity_stop", "terminate.v"), ("Activity_stop", "stop.v"), ("Activity_stop", "stop.v"), ("Activity_pause", "suspend.v")]
RELATIONS = [("Activity_stop", "Process_end -- Inheritance"), ("Activity_pause", "Activity -- Subframe")]
EXAMPLES = [
    ("Activity_stop", "stop.v", 51, 900, " They stopped at noon. "), ("Activity_stop", "terminate.v", 52, 880, "She terminated the call."),
    ("Activity_stop", "stop.v", 51, 910, "Stop the press."), ("Activity_stop", "stop.v", 51, 920, "It never stops."), ("Activity_pause", "suspend.v", 61, 700, "Work was suspended."),
]
#: Parsed sentences: text, place, lemma, part of speech, relation, head, entity of every token.
PARSED = {
    POLICIES[4][1]: [
        ("The", 0, "the", "DET", "det", 1, ""), ("client", 4, "client", "NOUN", "poss", 3, ""), ("'s", 10, "'s", "PART", "case", 1, ""), ("disqualification", 13, "disqualification", "NOUN", "nsubjpass", 5, ""),
        ("was", 30, "be", "AUX", "auxpass", 5, ""), ("suspended", 34, "suspend", "VERB", "ROOT", 5, ""), ("by", 44, "by", "ADP", "agent", 5, ""), ("the", 47, "the", "DET", "det", 9, ""), ("regional", 51, "regional", "ADJ", "amod", 9, ""),
        ("office", 60, "office", "NOUN", "pobj", 6, ""), ("until", 67, "until", "ADP", "prep", 5, ""), ("Monday", 73, "Monday", "PROPN", "pobj", 10, "DATE"), (".", 79, ".", "PUNCT", "punct", 5, ""),
    ],
    "Unless the client calls back today, the bureau imposes a penalty (D64).": [
        ("Unless", 0, "unless", "SCONJ", "mark", 3, ""), ("the", 7, "the", "DET", "det", 2, ""), ("client", 11, "client", "NOUN", "nsubj", 3, ""), ("calls", 18, "call", "VERB", "advcl", 9, ""), ("back", 24, "back", "ADV", "advmod", 3, ""), ("today", 29, "today", "NOUN", "npadvmod", 3, "DATE"),
        (",", 34, ",", "PUNCT", "punct", 9, ""), ("the", 36, "the", "DET", "det", 8, ""), ("bureau", 40, "bureau", "NOUN", "nsubj", 9, ""), ("imposes", 47, "impose", "VERB", "ROOT", 9, ""), ("a", 55, "a", "DET", "det", 11, ""), ("penalty", 57, "penalty", "NOUN", "dobj", 9, ""),
        ("(", 65, "(", "PUNCT", "punct", 11, ""), ("D64", 66, "D64", "PROPN", "appos", 11, ""), (")", 69, ")", "PUNCT", "punct", 11, ""), (".", 70, ".", "PUNCT", "punct", 9, ""),
    ],
}


def parser(sentences: list[str]) -> list[list]:
    """A parser that knows the sentences of PARSED."""
    from docloom.operators.syntax import Token

    return [[Token(*t) for t in PARSED.get(s, [])] for s in sentences]


def table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list, names: str) -> str:
    """The same rows as a SQL table expression."""
    rows = [*rows]
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names}))"
