"""The document contract as data, and the checks generated from it.

A contract is a tree of :class:`Obj`, :class:`Arr` and :class:`Leaf`.  From it one
column expression is built: an array with a struct per violated rule.  Raw text is
parsed once into VARIANT, so "key absent", "null", and "wrong type" stay apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from candela.functions.text import sql_string
from candela.sources.schema import SIGNALS_KEY

# fixed values: enumerations and patterns of the contract
ID_PATTERN = "^CAND_[0-9]{7}$"
COMPANY_SIZES = ("1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+")
PROFICIENCIES = ("beginner", "intermediate", "advanced", "expert")
LANGUAGE_LEVELS = ("basic", "conversational", "professional", "native")
TIERS = ("tier_1", "tier_2", "tier_3", "tier_4", "unknown")
WORK_MODES = ("remote", "hybrid", "onsite", "flexible")
MAX_MESSAGES = 10

SEP = "\\u0001"  # sorts before every path character, so paths order element by element
VIOLATION_DDL = "array<struct<path: string, ord: int, rule: string, message: string>>"
EMPTY = f"cast(array() AS {VIOLATION_DDL})"


@dataclass(frozen=True)
class Leaf:
    kind: str                                  # string | number | integer | boolean
    lo: float | None = None
    hi: float | None = None
    enum: tuple[str, ...] = ()
    pattern: str | None = None
    nullable: bool = False


@dataclass(frozen=True)
class MapOf:
    """Object with free keys and one kind of value."""
    value: Leaf


@dataclass(frozen=True)
class Obj:
    fields: dict = field(default_factory=dict)
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class Arr:
    item: Obj
    min_items: int = 0
    max_items: int | None = None


TEXT = Leaf("string")
FLAG = Leaf("boolean")
COUNT = Leaf("integer", lo=0)
RATE = Leaf("number", lo=0, hi=1)


def candidate_contract(signals_key: str = SIGNALS_KEY) -> Obj:
    """The strict contract of a candidate document."""
    texts = lambda *names: {n: TEXT for n in names}
    profile = {
        **texts("anonymized_name", "headline", "summary", "location", "country"),
        "years_of_experience": Leaf("number", lo=0, hi=50),
        **texts("current_title", "current_company"),
        "current_company_size": Leaf("string", enum=COMPANY_SIZES),
        "current_industry": TEXT,
    }
    job = {
        **texts("company", "title", "start_date"),
        "end_date": Leaf("string", nullable=True),
        "duration_months": COUNT,
        "is_current": FLAG,
        "industry": TEXT,
        "company_size": Leaf("string", enum=COMPANY_SIZES),
        "description": TEXT,
    }
    school = {
        **texts("institution", "degree", "field_of_study"),
        "start_year": Leaf("integer", lo=1970, hi=2030),
        "end_year": Leaf("integer", lo=1970, hi=2035),
        "grade": Leaf("string", nullable=True),
        "tier": Leaf("string", enum=TIERS),
    }
    skill = {
        "name": TEXT,
        "proficiency": Leaf("string", enum=PROFICIENCIES),
        "endorsements": COUNT,
        "duration_months": COUNT,
    }
    certification = {"name": TEXT, "issuer": TEXT, "year": Leaf("integer")}
    language = {"language": TEXT, "proficiency": Leaf("string", enum=LANGUAGE_LEVELS)}
    salary = Obj({"min": Leaf("number", lo=0), "max": Leaf("number", lo=0)}, ("min", "max"))
    signals = {
        "profile_completeness_score": Leaf("number", lo=0, hi=100),
        "signup_date": TEXT,
        "last_active_date": TEXT,
        "open_to_work_flag": FLAG,
        "profile_views_received_30d": COUNT,
        "applications_submitted_30d": COUNT,
        "recruiter_response_rate": RATE,
        "avg_response_time_hours": Leaf("number", lo=0),
        "skill_assessment_scores": MapOf(Leaf("number", lo=0, hi=100)),
        "connection_count": COUNT,
        "endorsements_received": COUNT,
        "notice_period_days": Leaf("integer", lo=0, hi=180),
        "expected_salary_range_inr_lpa": salary,
        "preferred_work_mode": Leaf("string", enum=WORK_MODES),
        "willing_to_relocate": FLAG,
        "github_activity_score": Leaf("number", lo=-1, hi=100),
        "search_appearance_30d": COUNT,
        "saved_by_recruiters_30d": COUNT,
        "interview_completion_rate": RATE,
        "offer_acceptance_rate": Leaf("number", lo=-1, hi=1),
        "verified_email": FLAG,
        "verified_phone": FLAG,
        "linkedin_connected": FLAG,
    }
    return Obj(
        {
            "candidate_id": Leaf("string", pattern=ID_PATTERN),
            "profile": Obj(profile, tuple(profile)),
            "career_history": Arr(Obj(job, tuple(job)), 1, 10),
            "education": Arr(Obj(school, ("institution", "degree", "field_of_study", "start_year", "end_year")), 0, 5),
            "skills": Arr(Obj(skill, ("name", "proficiency", "endorsements"))),
            "certifications": Arr(Obj(certification, tuple(certification))),
            "languages": Arr(Obj(language, tuple(language))),
            signals_key: Obj(signals, tuple(signals)),
        },
        ("candidate_id", "profile", "career_history", "education", "skills", signals_key),
    )


def model_contract(signals_key: str = SIGNALS_KEY) -> Obj:
    """The looser record model: defaults for lists, nullable options, no upper list bound for education."""
    strict = candidate_contract(signals_key)
    f = strict.fields
    optional = lambda o, *names: Obj({k: replace(v, nullable=True) if k in names else v
                                      for k, v in o.fields.items()},
                                     tuple(r for r in o.required if r not in names))
    signals = f[signals_key]
    loose_signals = Obj({**signals.fields, "skill_assessment_scores": MapOf(Leaf("number"))},
                        tuple(r for r in signals.required if r != "skill_assessment_scores"))
    return Obj(
        {
            **f,
            "career_history": Arr(optional(f["career_history"].item, "end_date"), 1, 10),
            "education": Arr(optional(f["education"].item, "grade", "tier")),
            "skills": Arr(optional(f["skills"].item, "duration_months")),
            signals_key: loose_signals,
        },
        ("candidate_id", "profile", "career_history", signals_key),
    )


# --- generated checks ---------------------------------------------------------

# First three letters of schema_of_variant(); enough to tell the JSON kinds apart.
_KINDS = {
    "string": "= 'STR'",
    "boolean": "= 'BOO'",
    "number": "IN ('BIG', 'DEC', 'DOU', 'FLO')",
    "integer": "IN ('BIG', 'DEC', 'DOU', 'FLO')",
    "object": "= 'OBJ'",
}
RULES = ("required", "type", "range", "enum", "pattern", "cardinality")


def _number(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else repr(value)


def _join(path: str, name: str) -> str:
    """Extend a SQL path expression by one element."""
    tail = sql_string(name)
    return tail if path == "''" else f"concat({path}, '{SEP}', {tail})"


def _keys(ref: str) -> str:
    """MAP of an object's values; null when the value is no object."""
    return f"try_variant_get({ref}, '$', 'map<string,variant>')"


def _get(map_ref: str, key: str) -> str:
    return f"try_element_at({map_ref}, {sql_string(key)})"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _shape(node: Obj | Arr | MapOf | Leaf) -> str:
    """Type that opens a value down to its leaves, each a VARIANT of its own; what is of another kind comes out as null."""
    if isinstance(node, Obj):
        return f"struct<{', '.join(f'{_quoted(n)}: {_shape(c)}' for n, c in node.fields.items())}>"
    if isinstance(node, Arr):
        return f"array<{_shape(node.item)}>"
    return f"map<string,{_shape(node.value)}>" if isinstance(node, MapOf) else "variant"


def _held(*keys: str) -> str:
    """The document's value at these keys as a VARIANT, null when absent, of whatever kind."""
    ref = "v"
    for key in keys:
        ref = _get(_keys(ref), key)
    return ref


class _Checks:
    """Builds the SQL of one contract; ``lenient`` accepts text that casts to the wanted type."""

    def __init__(self, lenient: bool, rules: tuple[str, ...]):
        self.lenient = lenient
        self.rules = set(rules)

    def case(self, cond: str, path: str, ord_: int, rule: str, message: str) -> list[str]:
        """A nullable violation struct, or nothing when the rule is switched off."""
        if rule not in self.rules:
            return []
        return [f"CASE WHEN {cond} THEN named_struct('path', {path}, 'ord', {ord_}, 'rule', '{rule}', "
                f"'message', {sql_string(message)}) END"]

    def look(self, ref: str, leaf: Leaf) -> str:
        """STRUCT (kind, text) of a leaf's VARIANT, null when the key is absent; the text only where a rule reads it."""
        bounded = leaf.lo is not None or leaf.hi is not None or leaf.enum or leaf.pattern or leaf.kind == "integer"
        text = f"try_variant_get({ref}, '$', 'string')" if bounded or self.lenient else "cast(null AS string)"
        return f"CASE WHEN {ref} IS NOT NULL THEN named_struct('k', substring(schema_of_variant({ref}), 1, 3), 't', {text}) END"

    def looks(self, ref: str, node: Obj, keys: tuple[str, ...] = ()) -> str:
        """STRUCT of an object's looked at leaves, so every value is looked into once however many rules read it.

        A key that leads to an object or a map is true where it is present; ``keys`` lead from the document to this object.
        """
        at = {n: f"{ref}.{_quoted(n)}" for n in node.fields}
        pairs = ", ".join(f"{sql_string(n)}, " + (self.look(at[n], c) if isinstance(c, Leaf) else
                          f"CASE WHEN {at[n]} IS NOT NULL OR {_held(*keys, n)} IS NOT NULL THEN true END") for n, c in node.fields.items())
        return f"CASE WHEN {ref} IS NOT NULL THEN named_struct({pairs}) END"

    def leaf(self, at: str, path: str, leaf: Leaf) -> list[str]:
        """``at`` is the (kind, text) struct of the value, null when the key is absent."""
        kind, text = f"{at}.k", f"{at}.t"
        ok = f"{kind} {_KINDS[leaf.kind]}"
        number = f"try_cast({text} AS double)"
        if leaf.kind == "integer":
            ok = f"({ok} AND {number} = floor({number}))"
        if self.lenient and leaf.kind != "string":
            cast = {"number": "double", "integer": "bigint", "boolean": "boolean"}[leaf.kind]
            ok = f"({ok} OR ({kind} = 'STR' AND try_cast({text} AS {cast}) IS NOT NULL))"
            if leaf.kind == "boolean":
                ok = f"({ok} OR {text} IN ('0', '1'))"
        if leaf.nullable:
            ok = f"({ok} OR {kind} = 'VOI')"
        out = self.case(f"NOT {ok}", path, 1, "type", f"value is not of type {leaf.kind}")
        numeric = f"({kind} {_KINDS['number']}{f' OR {kind} = {chr(39)}STR{chr(39)}' if self.lenient else ''})"
        if leaf.lo is not None:
            out += self.case(f"{numeric} AND {number} < {_number(leaf.lo)}D", path, 2, "range",
                             f"value is less than the minimum of {_number(leaf.lo)}")
        if leaf.hi is not None:
            out += self.case(f"{numeric} AND {number} > {_number(leaf.hi)}D", path, 3, "range",
                             f"value is greater than the maximum of {_number(leaf.hi)}")
        if leaf.enum:
            allowed = ", ".join(sql_string(e) for e in leaf.enum)
            wrong = f"{text} NOT IN ({allowed}) OR {kind} <> 'STR'"
            guard = f"{kind} <> 'VOI' AND " if leaf.nullable else ""
            out += self.case(f"{guard}({wrong})", path, 4, "enum", "value is not one of the allowed values")
        if leaf.pattern:
            out += self.case(f"{kind} = 'STR' AND NOT {text} rlike {sql_string(leaf.pattern)}", path, 5, "pattern",
                             "value does not match the pattern")
        return out

    def flat(self, leaves: str, path: str, node: Obj) -> list[str]:
        """Required keys and plain values of an object given as a struct of leaves."""
        out: list[str] = []
        for name in node.required:
            out += self.case(f"{leaves} IS NOT NULL AND {leaves}.{name} IS NULL", path, 0, "required",
                             f"missing required key {name}")
        for name, child in node.fields.items():
            if isinstance(child, Leaf):
                out += self.leaf(f"{leaves}.{name}", _join(path, name), child)
        return out

    def array(self, value: str, items: str, path: str, node: Arr) -> str:
        """Violations of one list; ``items`` is an array of leaf structs, null when it is no list."""
        own = self.case(f"{items} IS NULL AND {value} IS NOT NULL", path, 1, "type", "value is not of type array")
        if node.min_items:
            own += self.case(f"size({items}) BETWEEN 0 AND {node.min_items - 1}", path, 2, "cardinality",
                             f"array has fewer than {node.min_items} items")
        if node.max_items is not None:
            own += self.case(f"size({items}) > {node.max_items}", path, 3, "cardinality",
                             f"array has more than {node.max_items} items")
        at = f"concat({path}, '{SEP}', lpad(cast(i AS string), 9, '0'))"
        each = self.case("e IS NULL", at, 1, "type", "value is not of type object") + self.flat("e", at, node.item)
        parts = [f"array_compact(array({', '.join(own)}))"] if own else []
        if each:
            parts.append(f"coalesce(flatten(transform({items}, (e, i) -> array_compact(array({', '.join(each)})))), {EMPTY})")
        return f"concat({', '.join(parts)})" if parts else EMPTY

    def map_values(self, leaves: str, path: str, leaf: Leaf) -> str:
        each = self.leaf("e.value", f"concat({path}, '{SEP}', e.key)", leaf)
        return (f"coalesce(flatten(transform(map_entries({leaves}), e -> array_compact(array({', '.join(each)})))), {EMPTY})"
                if each else EMPTY)


def add_violations(parsed: DataFrame, contract: Obj, lenient: bool = False, rules: tuple[str, ...] = RULES,
                   name: str = "violations") -> DataFrame:
    """Add the unsorted array of violations of the VARIANT column ``v``; null when it is no object.

    One cast opens the whole document down to its leaves, and helper columns hold each leaf's kind and text, so each
    value is unpacked once however many rules look at it. The cast does not tell an absent list or object from one of
    another kind; the document is asked for its keys only where one is missing.
    """
    checks = _Checks(lenient, rules)
    objects = {k: c for k, c in contract.fields.items() if isinstance(c, Obj)}
    lists = {k: c for k, c in contract.fields.items() if isinstance(c, Arr)}
    plain = Obj({k: c for k, c in contract.fields.items() if isinstance(c, Leaf)})
    nested = [(k, sub, grand) for k, node in objects.items() for sub, grand in node.fields.items() if isinstance(grand, (Obj, MapOf))]

    opened = parsed.withColumn("_r", F.expr(f"try_variant_get(v, '$', {sql_string(_shape(contract))})"))
    looked = {f"_s_{k}": F.expr(checks.looks(f"_r.{_quoted(k)}", node, (k,))) for k, node in objects.items()}
    if plain.fields:
        looked["_s"] = F.expr(checks.looks("_r", plain))
    for k, node in lists.items():
        looked[f"_a_{k}"] = F.expr(f"transform(_r.{_quoted(k)}, e -> {checks.looks('e', node.item)})")
    for k, sub, grand in nested:
        at = f"_r.{_quoted(k)}.{_quoted(sub)}"
        looked[f"_n_{k}_{sub}"] = F.expr(checks.looks(at, grand) if isinstance(grand, Obj) else
                                         f"transform_values({at}, (k, y) -> {checks.look('y', grand.value)})")
    opened = opened.withColumns(looked)

    own: list[str] = []
    for required in contract.required:
        own += checks.case(f"_r.{_quoted(required)} IS NULL AND {_held(required)} IS NULL", "''", 0, "required", f"missing required key {required}")
    for k, leaf in plain.fields.items():
        own += checks.leaf(f"_s.{k}", sql_string(k), leaf)
    for k, node in objects.items():
        own += checks.case(f"_r.{_quoted(k)} IS NULL AND {_held(k)} IS NOT NULL", sql_string(k), 1, "type",
                           "value is not of type object")
        own += checks.flat(f"_s_{k}", sql_string(k), node)
    parts: list[str] = []
    for k, sub, grand in nested:
        path, column = _join(sql_string(k), sub), f"_n_{k}_{sub}"
        own += checks.case(f"{column} IS NULL AND _s_{k}.{sub} IS NOT NULL", path, 1, "type", "value is not of type object")
        if isinstance(grand, Obj):
            own += checks.flat(column, path, grand)
        else:
            parts.append(checks.map_values(column, path, grand.value))
    for k, node in lists.items():
        parts.append(checks.array(_held(k), f"_a_{k}", sql_string(k), node))
    if own:
        parts.insert(0, f"array_compact(array({', '.join(own)}))")
    every = f"concat({', '.join(parts)})" if parts else EMPTY
    result = opened.withColumn(name, F.expr(f"CASE WHEN _r IS NOT NULL THEN {every} END"))
    return result.drop("_r", *looked)


def messages_sql(ref: str, limit: int = MAX_MESSAGES) -> str:
    """``[path] text`` of the first ``limit`` violations in path order."""
    shown = (f"concat('[', CASE WHEN x.path = '' THEN 'root' ELSE "
             f"regexp_replace(regexp_replace(x.path, '{SEP}0*([0-9]+)(?={SEP}|$)', '.$1'), '{SEP}', '.') END, "
             f"'] ', x.message)")
    return f"transform(slice(array_sort({ref}), 1, {int(limit)}), x -> {shown})"
