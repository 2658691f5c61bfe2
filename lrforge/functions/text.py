"""Scalar text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_FEATURE = "^key feature"
MESSAGE = "array<struct<role:string,content:string>>"

# Parts of messages that mark an error as one that may pass.
TRANSIENT_MARKERS = ("rate limit", "timeout", "temporar", "connection", "connection reset", "service unavailable", "502", "503", "504", "429")
# Patterns of secrets and of local paths that a repository must not hold.
SECRET_PATTERNS = (r"sk-proj-[A-Za-z0-9_-]{20,}", r"ghp_[A-Za-z0-9]{20,}", r"xox[baprs]-[A-Za-z0-9-]{10,}")
LOCAL_PATH_PATTERNS = (r"/Users/[A-Za-z0-9._-]+/", r"Box Sync")
# What a spreadsheet reader takes for an empty cell.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def strip(value: Column) -> Column:
    """Without white space at either end, no-break spaces included."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def collapse(value: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def normalize_cell(value: Column, collapse_inner: bool = False) -> Column:
    return F.coalesce(collapse(value) if collapse_inner else strip(value), F.lit(""))


def na_to_null(value: Column) -> Column:
    return F.when(~value.isin(*NA_TEXTS), value)


def is_key_feature(first_cell: Column, pattern: str = KEY_FEATURE) -> Column:
    return F.coalesce(normalize_cell(first_cell).rlike(f"(?i){pattern}"), F.lit(False))


def parenthetical_exemplars(label: Column) -> Column:
    """Items of the first parenthesis, without e.g., split at ; or , and not empty."""
    inner = F.regexp_replace(F.regexp_extract(label, r"\(([^)]*)\)", 1), r"(?i)^\s*e\.?g\.?[,:]?\s*", "")
    return F.filter(F.transform(F.split(inner, "[;,]"), strip), lambda x: x != "")


def exemplars(label: Column, n: int, strategy: str = "parenthetical") -> Column:
    """n exemplars: the parenthetical ones, or the label itself; cut or filled with empty texts."""
    if n < 1 or strategy not in ("parenthetical", "label"):
        raise ValueError(f"no {n} exemplars by {strategy}")
    found = parenthetical_exemplars(label) if strategy == "parenthetical" else F.array().cast("array<string>")
    found = F.when(F.size(found) > 0, found).otherwise(F.array(strip(label)))
    return F.slice(F.concat(found, F.array_repeat(F.lit(""), n)), 1, n)


def slug(label: Column, longest: int = 48, default: str = "category") -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(bare, 1, longest), "^_+|_+$", ""), F.lit("")), F.lit(default))


def pair_filename(index: Column, left: Column, right: Column) -> Column:
    return F.format_string("%03d__%s__vs__%s.xlsx", index, slug(left), slug(right))


def schema_sheet_name(order: Column, row_idx: Column, categories: Column) -> Column:
    return F.substring(F.format_string("s%02d_r%02d_%dcat", order, row_idx, categories), 1, 31)


def sheet_name(name: Column, keep: str = "first") -> Column:
    """Workbooks allow 31 characters: the first ones, or the last."""
    return F.right(name, F.lit(31)) if keep == "last" else F.left(name, F.lit(31))


def output_path(path: Column, prefix: str, scenario: Column, folder: str) -> Column:
    """Below the prefix if the path starts with it, else below the outputs folder in it, else scenario/basename."""
    tail = F.when(F.instr(path, f"{folder}/") > 0, F.nullif(F.substring_index(path, f"{folder}/", -1), F.lit("")))
    base = F.concat_ws("/", scenario, F.regexp_extract(path, r"([^/]+)$", 1))
    return F.when(path.startswith(prefix), F.regexp_replace(F.right(path, F.length(path) - len(prefix)), "^/+", "")).otherwise(F.coalesce(tail, base))


def relative_path(path: Column, root: str) -> Column:
    """A path below root without it; any other path as it is."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.right(path, F.length(path) - len(root))).otherwise(path)


def utc_text(time: Column, kind: str = "iso") -> Column:
    """A time as text in UTC, which the session's zone must be: iso, stamp (for file names) or day."""
    forms = {"iso": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx", "stamp": "yyyyMMdd'T'HHmmss'Z'", "day": "yyyy-MM-dd"}
    return F.date_format(time, forms[kind])


def model_output_path(root: str, model_id: Column, relative: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), model_token(model_id), relative)


def model_token(model_id: Column) -> Column:
    return F.replace(model_id, F.lit("/"), F.lit("_"))


def sanitize(name: Column, longest: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"\s+", "_"), "[^A-Za-z0-9_.-]", ""), 1, longest)


def unfence(response: Column) -> Column:
    """A response without its Markdown code fence."""
    return strip(F.regexp_replace(strip(response), r"^```(?:json)?\s*|\s*```$", ""))


def parse_response(response: Column, schema: str, strict: bool = False) -> Column:
    return F.from_json(unfence(response), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def example_list(examples: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.filter(examples, lambda x: x != ""), ", "), F.lit("")), F.lit("-"))


def messages(system: list[str], few_shot: list[tuple[str, str]], question: Column, reasoning: Column) -> Column:
    """System messages, worked examples (two of them for reasoning models) and the question."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), (content if isinstance(content, Column) else F.lit(content)).alias("content"))
    shots = lambda pairs: [x for q, a in pairs for x in (say("user", q), say("assistant", a))]
    head, tail = [say("system", s) for s in system], [say("user", question)]
    return F.when(reasoning, F.array(*head, *shots(few_shot[:2]), *tail)).otherwise(F.array(*head, *shots(few_shot), *tail)).cast(MESSAGE)


def model_capabilities(model_id: Column) -> Column:
    """What a model takes, by the beginning of its name."""
    m = F.lower(model_id)
    newest, reasons = m.startswith("gpt-5"), m.startswith("gpt-5") | m.startswith("o3") | m.startswith("o4")
    return F.struct(reasons.alias("reasoning"), newest.alias("verbosity"), (~reasons).alias("allow_temp"))


def parameter_ladder(model_id: Column) -> Column:
    """Sets of optional parameters to try in turn: all that a model takes, then all but verbosity, all but reasoning, all but temperature, at last none; each set once."""
    takes = model_capabilities(model_id)
    have = F.array_compact(F.array(F.when(takes["verbosity"], "verbosity"), F.when(takes["reasoning"], "reasoning"), F.when(takes["allow_temp"], "temperature")))
    less = lambda gone: F.array_remove(have, gone)
    return F.array_distinct(F.array(have, less("verbosity"), less("reasoning"), less("temperature"), F.array().cast("array<string>")))


def is_transient(error: Column) -> Column:
    return F.exists(F.array(*map(F.lit, TRANSIENT_MARKERS)), lambda m: F.contains(F.lower(error), m))


def matches_any(value: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_max(F.array(*[value.rlike(p) for p in patterns])), F.lit(False))


def numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("."))), "\n")


def clinical_context(features: Column) -> Column:
    """Numbered lines from an array of structs (feature, status)."""
    return numbered(F.transform(features, lambda x: F.concat(x["feature"], F.lit(" is "), x["status"])))


def transcript_prompt(infos: Column, transcript: Column) -> Column:
    return F.concat(
        F.lit("For each item of information, answer YES, NO or MISSING from the transcript.\n"),
        F.array_join(F.transform(infos, lambda x: F.concat(F.lit("Information: "), x)), "\n"), F.lit("\n\nTranscript:\n"), transcript,
    )


ANSWER_FORM = (
    'Answer with one JSON object and nothing else: {"for": [...], "against": [...], "summary": "..."}. Each list holds five objects '
    '{"finding": "...", "explanation": "...", "abbreviations": {"short": "long"}}, the strongest first. Give no numbers for strength.'
)
FEEDBACK = {
    "general_overall": (
        "Diagnosis in question: {d}\nKind of information: {k}\n\nWhich findings of this kind would speak most for the diagnosis, whoever the patient is, and which most against it? "
        "Judge by how much more often a finding occurs with the diagnosis than without it. For \"for\", a high ratio counts, to which a specific finding owes most; for \"against\", a low one, such as a sensitive test that is negative.\n"
    ),
    "general_differential": (
        "First diagnosis: {d}\nSecond diagnosis: {o}\nKind of information: {k}\n\nWhich findings of this kind tell the two apart best, whoever the patient is? "
        "Judge by how much more often a finding occurs with the first than with the second. \"for\" is for the first diagnosis, \"against\" for the second; findings that are common to both say little.\n"
    ),
    "specific_overall": (
        "Diagnosis in question: {d}\nKind of information: {k}\n{c}\n\nOf the findings above and no others, which speak most for the diagnosis in this patient, and which most against it? "
        "A finding that is absent can speak either way; one that was not asked for says nothing. Judge by how much more often it occurs with the diagnosis than without it.\n"
    ),
    "specific_differential": (
        "First diagnosis: {d}\nSecond diagnosis: {o}\nKind of information: {k}\n{c}\n\nOf the findings above and no others, which make the first diagnosis likelier than the second in this patient (\"for\"), and which the second (\"against\")? "
        "A finding that fits both equally well belongs to neither list. Say what a learner should ask next if the lists are short.\n"
    ),
}


def feedback_prompt(kind: str, diagnosis: Column, category: Column, context: Column | None = None, other: Column | None = None) -> Column:
    """Prompt of one of four kinds: general or specific (about the findings in context), for one diagnosis or between two."""
    parts = {"{d}": diagnosis, "{k}": category, "{c}": context, "{o}": other}
    pieces = re.split(r"(\{[dkco]\})", FEEDBACK[kind] + ANSWER_FORM.replace("{", "{{"))
    if any(parts[p] is None for p in pieces if p in parts):
        raise ValueError(f"a prompt of kind {kind} needs more than it was given")
    return F.concat(*[parts[p] if p in parts else F.lit(p.replace("{{", "{")) for p in pieces if p])


def checked_response(response: Column, fields: dict[str, tuple[float | None, float | None] | list[str]]) -> Column:
    """Struct of a response's fields and `errors`: what is missing, no number, outside its bounds (both exclusive, None for none), or no word of its list.

    A response that is no JSON object lacks all fields. A field with an error is null.
    """
    kinds = {f: "string" if isinstance(rule, list) else "double" for f, rule in fields.items()}
    read = F.from_json(unfence(response), ", ".join(f"`{f}` string" for f in fields))
    values, errors = [], []
    for f, rule in fields.items():
        raw = read[f]
        if isinstance(rule, list):
            fault = F.when(raw.isNull(), f"{f} is missing").when(~raw.isin(rule), F.concat(F.lit(f"{f} is none of its values: "), raw))
            value = raw
        else:
            low, high = rule
            value = raw.try_cast("double")
            inside = (F.lit(True) if low is None else value > low) & (F.lit(True) if high is None else value < high)
            number = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & ~raw.rlike("[dDfF]$")
            fault = F.when(raw.isNull(), f"{f} is missing").when(~number, F.concat(F.lit(f"{f} is no number: "), raw)).when(~inside, F.concat(F.lit(f"{f} is out of bounds: "), raw))
        errors.append(fault)
        values.append(F.when(fault.isNull(), value).cast(kinds[f]).alias(f))
    return F.struct(*values, F.array_compact(F.array(*errors)).alias("errors"))


def answer_of(text: Column) -> Column:
    """YES true, NO false, anything else (MISSING, NOT ASKED) null."""
    said = F.upper(strip(text))
    return F.when(said == "YES", True).when(said == "NO", False)


def is_tier_row(labels: Column) -> Column:
    return F.forall(labels, lambda x: F.startswith(F.lower(x), F.lit("tier ")))


def is_example_header(label: Column) -> Column:
    return F.startswith(F.lower(F.coalesce(label, F.lit(""))), F.lit("for examples:"))


def answers_file(transcript: Column) -> Column:
    return F.concat(F.lit("answers_"), F.regexp_replace(transcript, r"\.pdf$", ".xlsx"))


def references(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def signed_findings(finding: Column) -> Column:
    """A finding as its presence and its absence, unless it already states one of them."""
    has, lacks = "Patient has: ", "Patient does not have: "
    stated = F.lower(finding).startswith(has.strip().lower()) | F.lower(finding).startswith(lacks.strip().lower())
    return F.when(stated, F.array(finding)).otherwise(F.array(F.concat(F.lit(has), finding), F.concat(F.lit(lacks), finding)))


def token_estimate(text: Column) -> Column:
    """Tokens of a prompt, about four characters each."""
    return F.ceil(F.length(text) / 4).cast("int")
