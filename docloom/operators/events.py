"""Lifecycle events in policy text: trigger, actor, code, condition, time, polarity - native expressions over sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import syntax as S

# The phrases that are recognised.
TRIGGER = (
    r"(?i)\b(does\s+not\s+impose|cannot\s+be\s+imposed|must\s+be\s+imposed|is\s+not\s+imposed|is\s+imposed|imposes?|imposed|terminates?|terminated|"
    r"rescinds?|rescinded|suspends?|suspended|punishes?|punished|disciplines?|disciplined|rewards?|rewarded)\b"
)
CODE = r"(?i)(?:(\d{1,3})\s*-\s*([^.;:()]{3,100}?)\s+)?(disentitlement|disqualification|penalty)?\s*\(?(D\d{1,3})\)?"
CONDITION = (
    r"(?i)\b(?:if|when|unless)\s+(.+?)(?=,\s+(?:the\s+)?(?:officer|agent|system|commission)\b|,\s+it\s+(?:is|can\s+be|must\s+be)\s+(?:terminated|rescinded|suspended)\b|"
    r",?\s+(?:a|an|the)\s+\d|,?\s+(?:the\s+)?(?:officer|agent)\s+(?:imposes?|terminates?|rescinds?|suspends?)\b|[.;]|$)"
)
TIME = r"(?i)\b((?:starting|beginning|from|until|on)\s+(?:the\s+)?(?:date|day|Monday|Friday|week).+?)(?=[.;]|$)"
AGENT = r"(?i)\b(the\s+(?:officer|agent|system|Commission)|Service Canada)\b"
EVALUEE = r"(?i)\b(the\s+client|clients|the\s+claimant|claimants)\b"
ACTIVITY = r"(?i)\b(?:the\s+)?(?:disentitlement|disqualification|penalty|D\d+)\b"
HOURS = r"(?i)(?:not\s+accumulated\s+at\s+least|fewer\s+than)\s+(\d+)\s+insurable\s+hours"
WEEKS = r"(?i)between\s+w/c\s*(\d+)\s+and\s+w/c\s*(\d+)"
FRAMES = {"PenaltyImposition": "Rewards_and_punishments", "PenaltyTermination": "Activity_stop", "PenaltySuspension": "Activity_pause"}
SCHEMA_VERSION = "0.3.1"
NO_TRIGGER = "No supported penalty lifecycle trigger was found."


def _found(s: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null where nothing or nothing but '' matches."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def trigger(sentence: Column) -> Column:
    """struct(text, start, end) of the last trigger of a sentence, the one it asserts; null if there is none."""
    every = F.regexp_extract_all(sentence, F.lit(TRIGGER), 1)
    last = F.try_element_at(every, F.lit(-1))
    after = F.length(F.element_at(F.split(sentence, TRIGGER), -1))
    end = F.length(sentence) - after
    return F.when(F.size(every) > 0, F.struct(last.alias("text"), (end - F.length(last)).alias("start"), end.alias("end")))


def event_type(trigger_text: Column) -> Column:
    t, out = F.lower(trigger_text), F.lit("PenaltyImposition")
    for stem, kind in (("suspend", "PenaltySuspension"), ("rescind", "PenaltyRescission"), ("terminat", "PenaltyTermination")):
        out = F.when(F.contains(t, F.lit(stem)), kind).otherwise(out)
    return out


def polarity(trigger_text: Column) -> Column:
    return F.when(F.contains(F.lower(trigger_text), F.lit("not")), "negative").otherwise("positive")


def modality(trigger_text: Column) -> Column:
    t = F.lower(trigger_text)
    return F.when(F.contains(t, F.lit("must")), "required").when(F.contains(t, F.lit("cannot")), "prohibited").otherwise("asserted")


def penalty(sentence: Column) -> Column:
    """struct(text, code, number, label, sanctionType) of the first code of a sentence; null if it has none."""
    part = lambda k: _found(sentence, CODE, k)
    made = F.struct(
        F.trim(F.regexp_extract(sentence, CODE, 0)).alias("text"),
        F.upper(part(4)).alias("code"),
        part(1).cast("int").alias("number"),
        F.nullif(F.regexp_replace(part(2), "^[ -]+|[ -]+$", ""), F.lit("")).alias("label"),
        F.lower(part(3)).alias("sanctionType"),
    )
    return F.when(part(4).isNotNull(), made)


def condition(text: Column) -> Column:
    """A condition's text with its expression where it is one of the known kinds; null stays null."""
    t = F.regexp_replace(text, "^[ ,]+|[ ,]+$", "")
    hours, low, high = _found(t, HOURS, 1), _found(t, WEEKS, 1), _found(t, WEEKS, 2)
    less, between = hours.isNotNull(), hours.isNull() & low.isNotNull()
    made = F.struct(
        t.alias("text"),
        F.when(less, "lessThan").when(between, "betweenInclusive").alias("operator"),
        F.when(less, "client.accumulatedInsurableHours").when(between, "claim.BPCWeek").alias("left"),
        F.when(less, hours.cast("int")).alias("right"),
        F.when(less, "hour").alias("unit"),
        F.when(between, low.cast("int")).alias("lower"),
        F.when(between, high.cast("int")).alias("upper"),
        F.when(~less & ~between, "unresolved").alias("normalizationStatus"),
    )
    return F.when(text.isNotNull(), made)


def _role(name: str, rule: Column, syntax: str | None) -> tuple[Column, Column]:
    """A role's text and evidence: the parser's span if there is one, else the rule's, else unresolved."""
    kind = "struct<method:string,relation:string,head:string,start:int,end:int>"
    plain = lambda method: F.struct(F.lit(method).alias("method"), *[F.lit(None).alias(n) for n in ("relation", "head", "start", "end")]).cast(kind)
    if syntax is None:
        return rule, F.when(rule.isNotNull(), plain("domain_rule")).otherwise(plain("implicit_or_unresolved"))
    span = F.try_element_at(F.col(syntax), F.lit(name))
    parsed = F.coalesce(F.length(span["text"]) > 0, F.lit(False))
    evidence = F.struct(F.lit("dependency_parse").alias("method"), span["relation"].alias("relation"), span["head"].alias("head"), span["start"].alias("start"), span["end"].alias("end")).cast(kind)
    return F.when(parsed, span["text"]).otherwise(rule), F.when(parsed, evidence).when(rule.isNotNull(), plain("domain_rule")).otherwise(plain("implicit_or_unresolved"))


def events(sentences: DataFrame, key: str = "doc_id", syntax: str | None = None) -> DataFrame:
    """One row per sentence with a trigger: (key, sentence_index, sentence, event columns).

    ``sentences`` as ``text.sentences`` gives them.  ``syntax`` names a column of roles from a parser,
    map<role, struct<text, relation, head, start, end>>.  Except for impositions an event without code
    takes the last code before it in the document; sentences without trigger neither give nor take one.
    The window is per document.
    """
    t = trigger(F.col("sentence"))
    rows = sentences.withColumn("_t", t).where("_t is not null")
    rows = rows.withColumn("event_type", event_type(F.col("_t.text"))).withColumn("own_penalty", penalty(F.col("sentence")))
    before = Window.partitionBy(key).orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last("own_penalty", ignorenulls=True).over(before)
    rows = rows.withColumn("penalty_code", F.when((F.col("event_type") == "PenaltyImposition") | F.col("own_penalty").isNotNull(), F.col("own_penalty")).otherwise(carried))
    s = F.col("sentence")
    agent, agent_how = _role("agent", _found(s, AGENT), syntax)
    evaluee, evaluee_how = _role("evaluee", _found(s, EVALUEE), syntax)
    cond, cond_how = _role("condition", _found(s, CONDITION, 1), syntax)
    time, time_how = _role("time", _found(s, TIME, 1), syntax)
    frame = F.try_element_at(F.create_map(*[F.lit(x) for pair in FRAMES.items() for x in pair]), F.col("event_type"))
    return rows.select(
        key, "sentence_index", "sentence", "event_type", frame.alias("frame"),
        F.col("_t.text").alias("trigger"), F.col("_t.start").alias("trigger_start"), F.col("_t.end").alias("trigger_end"),
        polarity(F.col("_t.text")).alias("polarity"), modality(F.col("_t.text")).alias("modality"), "penalty_code",
        agent.alias("agent"), evaluee.alias("evaluee"), condition(cond).alias("rule_condition"), time.alias("time_text"),
        F.struct(agent_how.alias("Agent"), evaluee_how.alias("Evaluee"), cond_how.alias("Condition"), time_how.alias("Time")).alias("evidence"),
    )


def frame_elements() -> Column:
    """The frame elements of an event row by name; those that are missing but expected are implicit."""
    value = lambda text: F.struct(text.alias("text"), F.when(text.isNull(), True).alias("implicit"))
    some = lambda text: F.when(text.isNotNull(), value(text))
    cond, time = F.col("rule_condition.text"), F.col("time_text")
    imposed = F.create_map(F.lit("Agent"), value(F.col("agent")), F.lit("Evaluee"), value(F.col("evaluee")), F.lit("Response_action"), value(F.col("penalty_code.text")), F.lit("Reason"), some(cond), F.lit("Time"), some(time))
    other = F.create_map(F.lit("Agent"), value(F.col("agent")), F.lit("Activity"), value(_found(F.col("sentence"), ACTIVITY)), F.lit("Explanation"), some(cond), F.lit("Time"), some(time))
    return F.map_filter(F.when(F.col("event_type") == "PenaltyImposition", imposed).otherwise(other), lambda _, v: v.isNotNull())


def with_frames(found: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Events with ``frame_elements`` and ``frame_net`` (status, frame id, matched unit, valid and invalid elements).

    ``frames`` is a lookup (name, id, elements array<string>, lexical_units array<string>), broadcast as
    it has a row for each of the few frames of FRAMES.  Without it the status is ``registry_unavailable``
    and elements stay empty; events without frame are ``domain_event_only``.
    """
    none = F.map_filter(frame_elements(), lambda k, v: F.lit(False))
    unit = "struct<text:string,start:int,end:int,lexicalUnit:string>"
    if frames is None:
        status = F.when(F.col("frame").isNull(), "domain_event_only").otherwise("registry_unavailable")
        return found.withColumn("frame_elements", none).withColumn("frame_net", F.struct(status.alias("validationStatus"), F.lit(None).cast("long").alias("frameId"), F.lit(None).cast(unit).alias("target"), F.lit(None).cast("array<string>").alias("valid"), F.lit(None).cast("array<string>").alias("invalid")))
    known = frames.where(F.col("name").isin(*FRAMES.values())).dropDuplicates(["name"]).select(F.col("name").alias("frame"), F.col("id").cast("long").alias("_id"), F.col("elements").alias("_fe"), F.col("lexical_units").alias("_lu"))
    rows = found.join(F.broadcast(known), "frame", "left").withColumn("frame_elements", F.when(F.col("_id").isNotNull(), frame_elements()).otherwise(none))
    names = F.map_keys("frame_elements")
    target = F.when(F.col("_id").isNotNull(), match_unit(F.col("sentence"), F.col("_lu")))
    status = F.when(F.col("frame").isNull(), "domain_event_only").when(F.col("_id").isNull(), "registry_unavailable").when(target.isNotNull(), "validated_exact_lu").otherwise("validated_frame_no_exact_lu")
    net = F.struct(status.alias("validationStatus"), F.col("_id").alias("frameId"), target.alias("target"), F.array_intersect(names, "_fe").alias("valid"), F.array_except(names, "_fe").alias("invalid"))
    return rows.withColumn("frame_net", net).select(*found.columns, "frame_elements", "frame_net")


def match_unit(sentence: Column, units: Column) -> Column:
    """struct(text, start, end, lexicalUnit): the unit visible first (the longer one at a tie); null if none is."""
    lemma = lambda u: F.regexp_replace(F.regexp_replace(u, r"\.[^.]*$", ""), r"\s*\[[^]]+\]$", "")

    def hits(u: Column) -> Column:
        forms = X.surface_forms(lemma(u), F.element_at(F.split(u, r"\."), -1))

        def hit(form: Column) -> Column:
            pattern = F.concat(F.lit("(?i)\\b\\Q"), form, F.lit("\\E\\b"))
            at = F.regexp_instr(sentence, pattern)
            return F.struct((at - 1).alias("start"), (-F.length(form)).alias("shorter"), u.alias("unit"), F.substring(sentence, at, F.length(form)).alias("text"))

        return F.filter(F.transform(forms, hit), lambda h: h["start"] >= 0)

    best = F.array_min(F.flatten(F.transform(units, hits)))
    return F.when(best.isNotNull(), F.struct(best["text"].alias("text"), best["start"].alias("start"), (best["start"] + F.length(best["text"])).alias("end"), best["unit"].alias("lexicalUnit")))


def mapping_documents(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, schemaVersion, eventCount, events, warnings): a row per document, events in sentence order."""
    body = F.struct("sentence_index", *[c for c in found.columns if c not in (key, "sentence_index")])
    per = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sentence_index", F.to_json(body).alias("event")))).alias("e"))  # a document's own events
    rows = docs.select(key).distinct().join(per, key, "left")
    n = F.coalesce(F.size("e"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return rows.select(key, F.lit(SCHEMA_VERSION).alias("schemaVersion"), n.alias("eventCount"), F.coalesce(F.transform("e", lambda x: x["event"]), F.array().cast("array<string>")).alias("events"), F.when(n == 0, F.array(F.lit(NO_TRIGGER))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def clean_mapping(found: DataFrame) -> DataFrame:
    """Events without their evidence and frame validation."""
    return found.drop("evidence", "frame_net")


def highlights(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sentence_index, segment, start, end, type, text): each sentence in runs of one highlight.

    Roles are those of the event's own frame elements, as ``with_frames`` gives them: none without registry.
    Ranges are painted by priority, per character the highest wins; ``type`` is null where none is.
    """
    part = lambda *names: F.coalesce(*[F.try_element_at("frame_elements", F.lit(n))["text"] for n in names])
    low = F.lower(F.col("sentence"))

    def span(value: Column, kind: str, priority: int, last: bool = False) -> Column:
        at = F.instr(low, F.lower(value)) - 1
        if last:
            at = F.length(low) - F.instr(F.reverse(low), F.reverse(F.lower(value))) + 1 - F.length(value)
            at = F.when(F.contains(low, F.lower(value)), at).otherwise(-1)
        return F.struct(at.cast("int").alias("a"), (at + F.length(value)).cast("int").alias("b"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))

    ranges = F.array(
        span(F.coalesce(part("Reason", "Explanation"), F.col("rule_condition.text")), "reason", 1), span(part("Response_action", "Activity"), "response", 2), span(part("Time"), "time", 4),
        span(part("Evaluee"), "evaluee", 5), span(part("Agent"), "agent", 6), span(F.col("penalty_code.code"), "code", 7), span(F.col("trigger"), "trigger", 8, True),
    )
    ranges = F.filter(ranges, lambda r: F.coalesce(r["a"], F.lit(-1)) >= 0)
    top = lambda i: F.array_max(F.transform(F.filter(F.col("_r"), lambda r: (r["a"] <= i) & (i < r["b"])), lambda r: F.struct(r["priority"].alias("priority"), r["kind"].alias("kind"))))["kind"]
    chars = found.withColumn("_r", ranges).select(key, "sentence_index", "sentence", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("sentence") - 1), top)).alias("i", "type"))
    order = Window.partitionBy(key, "sentence_index").orderBy("i")
    new = F.when(F.coalesce("type", F.lit("")) != F.coalesce(F.lag(F.coalesce("type", F.lit(""))).over(order), F.lit("\0")), 1).otherwise(0)
    runs = chars.withColumn("_new", new).withColumn("segment", F.sum("_new").over(order) - 1)
    out = runs.groupBy(key, "sentence_index", "sentence", "segment", "type").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    return out.select(key, "sentence_index", "segment", "start", "end", "type", F.expr("substring(sentence, start + 1, end - start)").alias("text"))


def evidence_rows(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sentence_index, event_type, role, method, relation): how each role was found."""
    roles = F.array(*[F.struct(F.lit(n).alias("role"), F.col(f"evidence.{n}").alias("how")) for n in ("Agent", "Evaluee", "Condition", "Time")])
    return found.select(key, "sentence_index", "event_type", F.explode(roles).alias("r")).select(key, "sentence_index", "event_type", "r.role", "r.how.method", "r.how.relation")


def map_text(docs: DataFrame, key: str = "doc_id", text: str = "text", frames: DataFrame | None = None, parser: S.Parser | None = None) -> DataFrame:
    """Documents to events: lines cleaned, sentences split, events found, frames validated.

    With a ``parser`` roles come from its parse of the sentences that have a trigger, and from the rules
    where it finds none.
    """
    cleaned = docs.select(key, X.clean_lines(text).alias("_text"))
    sentences = X.sentences(cleaned, [key], "_text")
    if parser is None:
        return with_frames(events(sentences, key), frames)
    sentences = sentences.withColumn("_t", trigger(F.col("sentence"))).where("_t is not null")
    parsed = sentences.withColumn("syntax", S.roles_column(F.col("sentence"), F.col("_t.start"), F.col("_t.end"), parser)).drop("_t")
    return with_frames(events(parsed, key, "syntax"), frames)
