"""Evidence states, edits and the ten constraint families, as column expressions on one record.

A state is a struct: facts of the focus subject and object (arrays of (p, o)), the predicates present there, and the
(entity, predicate) pairs that an edit touched but could not resolve. Records keep their place: nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import local_properties

FACTS = "array<struct<p:bigint,o:bigint>>"
PAIRS = "array<struct<e:bigint,p:bigint>>"


def _zip(predicates: str, objects: str) -> Column:
    """Facts of one entity: pairs up to the shorter list, without zeros, once each, predicates local only."""
    ps, os_ = (F.coalesce(F.col(c), F.array().cast("array<bigint>")) for c in (predicates, objects))
    pairs = F.filter(F.arrays_zip(ps.alias("p"), os_.alias("o")), lambda x: (x["p"] != 0) & (x["o"] != 0))
    return F.array_distinct(F.filter(pairs, lambda x: F.array_contains("p_local", x["p"])))


def with_evidence(records: DataFrame) -> DataFrame:
    """Adds ``p_local``, ``x_id`` (the other entity, 0 if none) and the state ``pre``.

    Facts given for the other entity replace those of the object, and those of the object the subject's, where ids are
    equal.
    """
    x_id = F.when(F.coalesce("other_subject", F.lit(0)) != 0, F.col("other_subject")).otherwise(F.coalesce("other_object", F.lit(0).cast("long")))
    rows = records.withColumns({"p_local": local_properties(), "x_id": x_id}).withColumns(
        {
            "s_raw": _zip("subject_predicates", "subject_objects"),
            "o_raw": _zip("object_predicates", "object_objects"),
            "x_raw": _zip("other_entity_predicates", "other_entity_objects"),
        }
    )
    x_is = lambda e: (F.col("x_id") != 0) & (F.col("x_id") == F.col(e))
    s = F.when(x_is("subject"), F.col("x_raw")).when((F.col("object") != 0) & (F.col("object") == F.col("subject")), F.col("o_raw")).otherwise(F.col("s_raw"))
    none = F.array().cast(FACTS)
    o = F.when(F.col("object") == F.col("subject"), s).when(x_is("object"), F.col("x_raw")).when(F.col("object") == 0, none).otherwise(F.col("o_raw"))
    rows = rows.withColumns({"s_facts": s, "o_facts": o})
    pre = _state("s_facts", "o_facts", _predicates("s_facts"), _predicates("o_facts"), F.array().cast(PAIRS))
    return rows.withColumn("pre", pre)


def _predicates(facts: str) -> Column:
    return F.array_distinct(F.col(facts)["p"])


def _state(s: str, o: str, sp: Column, op: Column, missing: Column) -> Column:
    """Facts (s, o), their predicates (hs, ho), predicates ever present (sp, op), unknown pairs, whether the focus is there."""
    held = [F.col(c)["p"] for c in (s, o)]
    # Null where an id is; compiled, as all that is made once a candidate.
    focus = F.when(F.col("predicate").isNotNull() & F.col("object").isNotNull(), F.array_contains(F.col(s), F.struct(F.col("predicate").alias("p"), F.col("object").alias("o"))))
    names = ("s", "o", "hs", "ho", "sp", "op", "missing", "focus")
    return F.struct(*(c.alias(n) for n, c in zip(names, (F.col(s), F.col(o), *held, sp, op, missing, focus), strict=True)))


def resolved(value: Column) -> Column:
    """A role placeholder (1 to 6) as the record's value; null as 0."""
    out = F.coalesce(value.cast("long"), F.lit(0).cast("long"))
    roles = ("subject", "predicate", "object", "other_subject", "other_predicate", "other_object")
    return reduce(lambda a, ir: F.when(value == ir[0], F.col(ir[1])).otherwise(a), enumerate(roles, 1), out)


def with_edit(rows: DataFrame, slots: list[Column], name: str, closed: bool = True) -> DataFrame:
    """Adds the state ``name`` after an edit of six slots (added triple, deleted triple): deletion first, then addition;
    and ``touched``, the predicates of the edit: what doesn't depend on them is as before.

    An incomplete triple does nothing. An edit whose predicate is not local, whose entity is out of scope or, in the
    open world, whose predicate was not present before, changes nothing and marks its (entity, predicate) as unknown.
    """
    parts = {f"e_{a}_{x}": resolved(s) for (a, x), s in zip([(a, x) for a in ("add", "del") for x in "spo"], slots, strict=True)}
    rows = rows.withColumns(parts)
    ready, reached = {}, {}
    for a in ("add", "del"):
        s, p, o = (F.col(f"e_{a}_{x}") for x in "spo")
        ready[a] = (s != 0) & (p != 0) & (o != 0)
        in_scope = s.isin(F.col("subject")) | ((F.col("object") != 0) & (s == F.col("object"))) | ((F.col("x_id") != 0) & (s == F.col("x_id")))
        good = in_scope & F.array_contains("p_local", p)
        if not closed:
            present = F.when(s == F.col("subject"), F.array_contains("pre.sp", p)).when(s == F.col("object"), F.array_contains("pre.op", p))
            good = good & present.otherwise(F.array_contains(F.transform("x_raw", lambda x: x["p"]), p))
        reached[a] = ready[a] & good

    def facts(start: str, entity: str) -> Column:
        gone = F.struct(F.col("e_del_p").alias("p"), F.col("e_del_o").alias("o"))
        new = F.struct(F.col("e_add_p").alias("p"), F.col("e_add_o").alias("o"))
        less = F.when(reached["del"] & (F.col("e_del_s") == F.col(entity)), F.array_remove(start, gone)).otherwise(F.col(start))
        more = reached["add"] & (F.col("e_add_s") == F.col(entity)) & ~F.array_contains(less, new)
        return F.when(more, F.concat(less, F.array(new))).otherwise(less)

    def present(start: str, entity: str) -> Column:
        if closed:  # only the open world asks
            return F.col(start)
        more = reached["add"] & (F.col("e_add_s") == F.col(entity))
        return F.when(more, F.array_union(start, F.array("e_add_p"))).otherwise(F.col(start))

    pair = lambda a: F.array(F.struct(F.col(f"e_{a}_s").alias("e"), F.col(f"e_{a}_p").alias("p")))
    unknown = F.concat(*(F.when(ready[a] & ~reached[a], pair(a)).otherwise(F.array().cast(PAIRS)) for a in ("del", "add")))
    rows = rows.withColumns({"e_s": facts("pre.s", "subject"), "e_o": facts("pre.o", "object")})
    state = _state("e_s", "e_o", present("pre.sp", "subject"), present("pre.op", "object"), unknown)
    return rows.withColumns({name: state, "touched": F.array("e_add_p", "e_del_p")}).drop(*parts, "e_s", "e_o")


class Check:
    """Checkability and satisfaction of an instance in the state column ``state``; a row has the record and instance.

    Rules are SQL text: one expression a family, so that plans are built in a few calls. ``of`` is where the instance's
    fields stand: in columns, or ("c.") in a struct that a lambda runs over.
    """

    def __init__(self, state: str, closed: bool = True, of: str = "") -> None:
        self.state, self.closed, self.of = state, closed, of
        self.property = f"{of}property"
        self.focus = f"{state}.focus"
        self.local = f"array_contains(p_local, {self.property})"
        self.free = f"not {self.guarded('s', self.property)}"
        self.base = f"subject <> 0 and {self.property} <> 0 and {self.free}"
        self.complete = self.known("s", self.property)

    def has(self, of: str, p: str) -> str:
        return f"array_contains({self.state}.h{of}, {p})"

    def known(self, of: str, p: str) -> str:
        """The property is complete or present at an entity in scope (the focus subject always is)."""
        if self.closed:
            return "true" if of == "s" else "object <> 0"
        return f"array_contains({self.state}.{of}p, {p})"

    def guarded(self, of: str, p: str) -> str:
        return f"exists({self.state}.missing, m -> m.e = {'subject' if of == 's' else 'object'} and m.p = {p})"

    def usable(self, of: str, props: str) -> str:
        """Every property is local, free of unknown edits and known at the entity."""
        return f"forall({props}, p -> p <> 0 and array_contains(p_local, p) and not {self.guarded(of, 'p')} and {self.known(of, 'p')})"

    def triggered(self, trigger: str, then: str) -> str:
        """Without the trigger, completeness of the property decides."""
        return f"if({trigger}, {then}, {self.complete})"

    def conflict_with(self) -> tuple[str, str]:
        own = f"{self.of}conflicts"
        props = f"if(size({own}) = 0 and other_predicate <> 0, array(other_predicate), {own})"
        good = f"{self.base} and {self.local} and size({props}) > 0 and {self.usable('s', props)} and {self.complete}"
        return good, f"not ({self.has('s', self.property)} and exists({props}, q -> {self.has('s', 'q')}))"

    def inverse(self) -> tuple[str, str]:
        then = f"object <> 0 and {self.usable('o', f'{self.of}inverses')}"
        back = f"exists({self.state}.o, x -> array_contains({self.of}inverses, x.p) and x.o = subject)"
        return f"{self.base} and predicate = {self.property} and {self.triggered(self.focus, then)}", f"not {self.focus} or {back}"

    def item_requires(self) -> tuple[str, str]:
        trigger, required = self.has("s", self.property), f"{self.of}required"
        good = f"{self.base} and size({required}) > 0 and {self.local} and {self.triggered(trigger, self.usable('s', required))}"
        return good, f"not {trigger} or forall({required}, q -> {self.has('s', 'q')})"

    def value_requires(self) -> tuple[str, str]:
        required = f"{self.of}required"
        then = f"object <> 0 and size({required}) > 0 and {self.usable('o', required)}"
        good = f"{self.property} <> 0 and {self.free} and predicate = {self.property} and {self.triggered(self.focus, then)}"
        return good, f"not {self.focus} or forall({required}, q -> {self.has('o', 'q')})"

    def one_of(self) -> tuple[str, str]:
        items = f"{self.of}items"
        good = f"size({items}) > 0 and predicate = {self.property} and {self.local} and {self.free} and {self.triggered(self.focus, 'object <> 0')}"
        return good, f"not {self.focus} or array_contains({items}, object)"

    def single(self) -> tuple[str, str]:
        return f"{self.base} and {self.local} and {self.complete}", f"size(filter({self.state}.hs, x -> x = {self.property})) <= 1"

    def _typed(self, of: str) -> tuple[str, str]:
        trigger, entity = self.has("s", self.property), "subject" if of == "s" else "object"
        relations, classes = f"{self.of}relations", f"{self.of}classes"
        some = f"exists({relations}, r -> {self.has(of, 'r')})"
        then = f"size({relations}) > 0 and {self.usable(of, relations)} and {some}"
        good = f"{entity} <> 0 and {self.property} <> 0 and {self.local} and {self.free} and size({classes}) > 0 and {self.triggered(trigger, then)}"
        return good, f"not {trigger} or exists({self.state}.{of}, x -> array_contains({relations}, x.p) and array_contains({classes}, x.o))"

    def distinct(self) -> tuple[str, str]:
        other = f"other_subject <> 0 and other_predicate <> 0 and other_object <> 0 and other_predicate = {self.property}"
        rival = f"{other} and other_object = object and other_subject <> subject"
        return f"{self.base} and {self.local} and {self.triggered(self.focus, other)}", f"not {self.focus} or not ({rival})"

    def families(self) -> dict[str, Callable[[], tuple[str, str]]]:
        return {
            "conflictWith": self.conflict_with, "inverse": self.inverse, "symmetric": self.inverse,
            "itemRequiresStatement": self.item_requires, "valueRequiresStatement": self.value_requires, "oneOf": self.one_of,
            "single": self.single, "type": lambda: self._typed("s"), "valueType": lambda: self._typed("o"), "distinct": self.distinct,
        }

    def rules(self, checkable_name: str) -> tuple[str, str]:
        """SQL of (checkable, satisfied): false where a family has no checker; satisfied only where checkable.

        Satisfaction reads the first of the two from ``checkable_name``, so that it isn't computed twice.
        """
        rules = {family: check() for family, check in self.families().items()}
        case = lambda i: f"case {self.of}family " + " ".join(f"when '{f}' then {r[i]}" for f, r in rules.items()) + " else false end"
        return f"coalesce({self.of}supported and {case(0)}, false)", f"{checkable_name} and coalesce({case(1)}, false)"

    def columns(self, checkable_name: str) -> tuple[Column, Column]:
        checkable, satisfied = self.rules(checkable_name)
        return F.expr(checkable), F.expr(satisfied)


class EntryCheck(Check):
    """``Check`` of one registry entry whose fields are known when the plan is made: lists are written out, and no lambda is left,
    so that the rules are compiled. Ids of the record are not null."""

    def __init__(self, state: str, entry: dict, closed: bool = True) -> None:
        super().__init__(state, closed)
        self.entry = entry
        self.property = self.literal(entry["property"])
        self.local = f"array_contains(p_local, {self.property})"
        self.free = f"not {self.guarded('s', self.property)}"
        self.base = f"subject <> 0 and {self.property} <> 0 and {self.free}"
        self.complete = self.known("s", self.property)

    @staticmethod
    def literal(value: int | None) -> str:
        return "cast(null as bigint)" if value is None else f"{value}L"

    def listed(self, name: str) -> list[str]:
        return [self.literal(v) for v in self.entry[name] or ()]

    @staticmethod
    def every(parts: list[str]) -> str:
        return f"({' and '.join(parts) or 'true'})"

    @staticmethod
    def some(parts: list[str]) -> str:
        return f"({' or '.join(parts) or 'false'})"

    def fact(self, of: str, p: str, o: str) -> str:
        return f"array_contains({self.state}.{of}, named_struct('p', {p}, 'o', {o}))"

    def guarded(self, of: str, p: str) -> str:
        return f"array_contains({self.state}.missing, named_struct('e', {'subject' if of == 's' else 'object'}, 'p', {p}))"

    def usable_all(self, of: str, props: list[str]) -> str:
        return self.every([f"{p} <> 0 and array_contains(p_local, {p}) and not {self.guarded(of, p)} and {self.known(of, p)}" for p in props])

    def conflict_with(self) -> tuple[str, str]:
        props = self.listed("conflicts") or ["other_predicate"]
        there = "true" if self.listed("conflicts") else "other_predicate <> 0"
        good = f"{self.base} and {self.local} and {there} and {self.usable_all('s', props)} and {self.complete}"
        return good, f"not ({self.has('s', self.property)} and {self.some([self.has('s', q) for q in props])})"

    def inverse(self) -> tuple[str, str]:
        then = f"object <> 0 and {self.usable_all('o', self.listed('inverses'))}"
        back = self.some([self.fact("o", p, "subject") for p in self.listed("inverses")])
        return f"{self.base} and predicate = {self.property} and {self.triggered(self.focus, then)}", f"not {self.focus} or {back}"

    def item_requires(self) -> tuple[str, str]:
        trigger, required = self.has("s", self.property), self.listed("required")
        if not required:
            return "false", "false"
        good = f"{self.base} and {self.local} and {self.triggered(trigger, self.usable_all('s', required))}"
        return good, f"not {trigger} or {self.every([self.has('s', q) for q in required])}"

    def value_requires(self) -> tuple[str, str]:
        required = self.listed("required")
        then = f"object <> 0 and {self.usable_all('o', required)}" if required else "false"
        good = f"{self.property} <> 0 and {self.free} and predicate = {self.property} and {self.triggered(self.focus, then)}"
        return good, f"not {self.focus} or {self.every([self.has('o', q) for q in required])}"

    def one_of(self) -> tuple[str, str]:
        items = self.listed("items")
        if not items:
            return "false", "false"
        good = f"predicate = {self.property} and {self.local} and {self.free} and {self.triggered(self.focus, 'object <> 0')}"
        return good, f"not {self.focus} or array_contains(array({', '.join(items)}), object)"

    def single(self) -> tuple[str, str]:
        held = f"{self.state}.hs"
        return f"{self.base} and {self.local} and {self.complete}", f"size({held}) - size(array_remove({held}, {self.property})) <= 1"

    def _typed(self, of: str) -> tuple[str, str]:
        trigger, entity = self.has("s", self.property), "subject" if of == "s" else "object"
        relations, classes = self.listed("relations"), self.listed("classes")
        if not classes:
            return "false", "false"
        then = f"{self.usable_all(of, relations)} and {self.some([self.has(of, r) for r in relations])}"
        good = f"{entity} <> 0 and {self.property} <> 0 and {self.local} and {self.free} and {self.triggered(trigger, then)}"
        return good, f"not {trigger} or {self.some([self.fact(of, r, c) for r in relations for c in classes])}"

    def flag(self) -> str:
        """SQL of 0 (not checkable), 1 (checkable) or 3 (satisfied as well)."""
        checkable, satisfied = self.families()[self.entry["family"]]()
        return f"if(coalesce({checkable}, false), if(coalesce({satisfied}, false), 3, 1), 0)"


def flags(entries: list[dict], state: str, closed: bool = True) -> str:
    """SQL of an array: the ``flag`` of each entry in a state."""
    return f"array({', '.join(EntryCheck(state, e, closed).flag() for e in entries)})"
