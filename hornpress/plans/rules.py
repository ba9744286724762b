"""First-order Horn rules as small immutable trees, kept on the driver.

An argument is None (an anonymous variable, written ?), a Var (used at least twice) or a Const. A
rule's first atom is its head. A rule's length grows by one with each step that builds it: the
number of constants, plus for each variable its occurrences less one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import permutations


@dataclass(frozen=True, order=True)
class Var:
    n: int


@dataclass(frozen=True, order=True)
class Const:
    value: int


Arg = Var | Const | None
#: (atom number, argument number)
Place = tuple[int, int]


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple[Arg, ...]

    def put(self, i: int, arg: Arg) -> Atom:
        return Atom(self.pred, (*self.args[:i], arg, *self.args[i + 1 :]))

    @property
    def vars(self) -> list[Var]:
        return [a for a in self.args if isinstance(a, Var)]


@dataclass(frozen=True)
class Rule:
    atoms: tuple[Atom, ...]

    @staticmethod
    def start(pred: str, arity: int) -> Rule:
        return Rule((Atom(pred, (None,) * arity),))

    @property
    def head(self) -> Atom:
        return self.atoms[0]

    @property
    def body(self) -> tuple[Atom, ...]:
        return self.atoms[1:]

    @cached_property
    def places(self) -> dict[Var, list[Place]]:
        found: dict[Var, list[Place]] = {}
        for a, atom in enumerate(self.atoms):
            for i, arg in enumerate(atom.args):
                if isinstance(arg, Var):
                    found.setdefault(arg, []).append((a, i))
        return dict(sorted(found.items()))

    @property
    def empty(self) -> list[Place]:
        return [(a, i) for a, atom in enumerate(self.atoms) for i, arg in enumerate(atom.args) if arg is None]

    @property
    def length(self) -> int:
        constants = sum(isinstance(arg, Const) for atom in self.atoms for arg in atom.args)
        return constants + sum(len(p) - 1 for p in self.places.values())

    # --- steps -------------------------------------------------------------------------------

    def _put(self, place: Place, arg: Arg) -> Rule:
        a, i = place
        return Rule((*self.atoms[:a], self.atoms[a].put(i, arg), *self.atoms[a + 1 :]))

    def _add(self, pred: str, arity: int, i: int, var: Var) -> Rule:
        return Rule((*self.atoms, Atom(pred, (None,) * arity).put(i, var)))

    def join_known(self, place: Place, var: Var) -> Rule:
        """Case 1: an empty argument takes a known variable."""
        return self._put(place, var)

    def add_known(self, pred: str, arity: int, i: int, var: Var) -> Rule:
        """Case 2: a new atom takes a known variable."""
        return self._add(pred, arity, i, var)

    def join_new(self, one: Place, other: Place) -> Rule:
        """Case 3: two empty arguments take a new variable."""
        var = Var(len(self.places))
        return self._put(one, var)._put(other, var)

    def add_new(self, pred: str, arity: int, i: int, place: Place) -> Rule:
        """Case 4: an empty argument and a new atom take a new variable."""
        var = Var(len(self.places))
        return self._put(place, var)._add(pred, arity, i, var)

    def bind(self, place: Place, value: int) -> Rule:
        """Case 5: an empty argument takes a constant."""
        return self._put(place, Const(value))

    def generalize(self, place: Place) -> Rule:
        """An argument becomes empty. A variable left in one place becomes empty too, and the last
        variable takes its number; body atoms without any argument go."""
        arg = self.atoms[place[0]].args[place[1]]
        rule = self._put(place, None)
        if isinstance(arg, Var) and len(rest := rule.places.get(arg, [])) <= 1:
            for p in rest:
                rule = rule._put(p, None)
            last = Var(len(self.places) - 1)
            for p in rule.places.get(last, []) if last != arg else []:
                rule = rule._put(p, arg)
        return Rule((rule.head, *(b for b in rule.body if any(x is not None for x in b.args))))

    # --- identity ------------------------------------------------------------------------------

    @cached_property
    def classes(self) -> list[list[Counter]]:
        """Of each argument the multiset of what it equals: (relation, column) places, and a constant."""
        by_var = {v: Counter((self.atoms[a].pred, i) for a, i in places) for v, places in self.places.items()}
        return [[by_var[arg] if isinstance(arg, Var) else Counter([(atom.pred, i), *([("=", arg.value)] if isinstance(arg, Const) else [])]) for i, arg in enumerate(atom.args)] for atom in self.atoms]

    @cached_property
    def fingerprint(self) -> tuple:
        """Equal for rules that differ in variable names or atom order (and for a few others)."""

        def frozen(c: Counter) -> tuple:
            return tuple(sorted(c.items(), key=str))

        every = [frozen(self.classes[p[0][0]][p[0][1]]) for p in self.places.values()]
        every += [frozen(self.classes[a][i]) for a, atom in enumerate(self.atoms) for i, arg in enumerate(atom.args) if not isinstance(arg, Var)]
        return self.head.pred, tuple(frozen(c) for c in self.classes[0]), tuple(sorted(every, key=str))

    def generalization_of(self, other: Rule) -> bool:
        """By classes: the head's are within the other's, and each body atom's within some body atom's."""

        def within(a: int, b: int) -> bool:
            same = self.atoms[a].pred == other.atoms[b].pred and len(self.atoms[a].args) == len(other.atoms[b].args)
            return same and all(x <= y for x, y in zip(self.classes[a], other.classes[b], strict=True))

        if len(self.atoms) > len(other.atoms) or not within(0, 0):
            return False
        if len(self.head.args) == 2:
            tied = [isinstance(r.head.args[0], Var) and r.head.args[0] == r.head.args[1] for r in (self, other)]
            if tied[0] != tied[1]:
                return False
        return all(any(within(a, b) for b in range(1, len(other.atoms))) for a in range(1, len(self.atoms)))

    @property
    def invalid(self) -> bool:
        """Not worth a look: unlinked parts, an atom that repeats the head's argument or another atom."""
        head, seen = self.head, set()
        if self.body and not head.vars:
            return True
        for b in self.body:
            if not b.vars:
                return True
            if b.pred == head.pred and any(x is not None and x == y for x, y in zip(head.args, b.args, strict=True)):
                return True
            if None not in b.args:
                if b in seen:
                    return True
                seen.add(b)
        return len(linked([set(a.vars) for a in self.atoms if a.vars])) > 1

    def __str__(self) -> str:
        return self.text(str)

    def text(self, name: Callable[[int], str] = str) -> str:
        def arg(a: Arg) -> str:
            return "?" if a is None else f"X{a.n}" if isinstance(a, Var) else name(a.value)

        shown = [f"{a.pred}({','.join(map(arg, a.args))})" for a in self.atoms]
        return f"{shown[0]}:-{','.join(shown[1:])}"


def linked(groups: list[set]) -> list[set]:
    """Sets that share members, merged."""
    out: list[set] = []
    for g in groups:
        near = [o for o in out if o & g]
        out = [o for o in out if not o & g] + [g.union(*near)]
    return out


ATOM = re.compile(r"\s*([^\s(),?:]+)\s*\(([^()]*)\)\s*(,|:-|$)")


def parse_rule(text: str, number: Callable[[str], int] | None = None) -> Rule:
    """From `head(X,?,c):-body(X,?)`.

    ? and names used once are anonymous; names that begin with a capital are variables, numbered in
    order of appearance; whole numbers are constants, other names constants by `number`.
    """
    raw, at = [], 0
    while at < len(text.rstrip()):
        found = ATOM.match(text, at)
        if not found or (found[3] == ":-") != (not raw):
            raise ValueError(f"no rule: {text!r}")
        raw.append((found[1], [x.strip() for x in found[2].split(",")] if found[2].strip() else []))
        at = found.end()
    if not raw:
        raise ValueError("no rule: empty text")
    used = Counter(x for _, args in raw for x in args if x[:1].isupper())
    ids: dict[str, Var] = {}

    def arg(x: str) -> Arg:
        if not x:
            raise ValueError(f"no rule: {text!r}")
        if x == "?" or used[x] == 1:
            return None
        if x[0].isupper():
            return ids.setdefault(x, Var(len(ids)))
        if re.fullmatch(r"\d+", x):
            return Const(int(x))
        if number is None:
            raise ValueError(f"unknown constant {x!r}")
        return Const(number(x))

    return Rule(tuple(Atom(p, tuple(arg(x) for x in args)) for p, args in raw))


def steps_to(rule: Rule) -> list[Rule]:
    """The rules on a way from the empty head to `rule`; an error if a part of it is not linked to the head."""
    if rule.invalid and len(linked([set(a.vars) for a in rule.atoms if a.vars])) > 1:
        raise ValueError(f"{rule} has a part that isn't linked to its head")
    way = [rule]
    while any(arg is not None for a in way[-1].atoms for arg in a.args):
        now = way[-1]
        places = [(a, i) for a, atom in enumerate(now.atoms) for i, arg in enumerate(atom.args) if arg is not None]
        fewer = (now.generalize(p) for p in reversed(places))
        # a step back is one shorter and leaves no part behind
        way.append(next(r for r in fewer if r.length == now.length - 1 and len(linked([set(a.vars) for a in r.atoms if a.vars])) <= 1))
    return way[::-1]


# --- slow tests of identity, for checking ------------------------------------------------------


def same_rule(one: Rule, other: Rule) -> bool:
    """Equal up to variable names and the order of body atoms."""
    if len(one.atoms) != len(other.atoms) or len(one.places) != len(other.places):
        return False
    names = list(other.places)
    for perm in permutations(names):
        mapped = dict(zip(one.places, perm, strict=True))
        atoms = [Atom(a.pred, tuple(mapped[x] if isinstance(x, Var) else x for x in a.args)) for a in one.atoms]
        if atoms[0] == other.head and Counter(atoms[1:]) == Counter(other.body):
            return True
    return False


def is_specialization(special: Rule, general: Rule) -> bool:
    """Whether steps back from `special` reach `general`."""
    todo, seen = [special], set()
    while todo:
        r = todo.pop()
        if same_rule(r, general):
            return True
        if r.length > general.length and str(r) not in seen:
            seen.add(str(r))
            todo += [r.generalize((a, i)) for a, atom in enumerate(r.atoms) for i, arg in enumerate(atom.args) if arg is not None]
    return False


# --- neighbours -------------------------------------------------------------------------------

#: (relation, arity) of every relation, in order
Schema = list[tuple[str, int]]


#: What a step asks of groundings: ("eq", place, place), ("is", place, constant) or ("in", place, (relation, column))
Move = tuple[str, Place, object]


def moves(rule: Rule, schema: Schema, constants: dict[tuple[str, int], list[int]]) -> Iterator[tuple[Rule, Move]]:
    """Every rule one step longer: known variables first, then each empty argument's constants, pairs and new atoms."""
    empty = rule.empty
    for var, places in rule.places.items():
        yield from ((rule.join_known(p, var), ("eq", p, places[0])) for p in empty)
        yield from ((rule.add_known(pred, arity, i, var), ("in", places[0], (pred, i))) for pred, arity in schema for i in range(arity))
    for k, place in enumerate(empty):
        pred = rule.atoms[place[0]].pred
        yield from ((rule.bind(place, c), ("is", place, c)) for c in constants.get((pred, place[1]), []))
        yield from ((rule.join_new(place, other), ("eq", place, other)) for other in empty[k + 1 :])
        yield from ((rule.add_new(pred, arity, i, place), ("in", place, (pred, i))) for pred, arity in schema for i in range(arity))


def specializations(rule: Rule, schema: Schema, constants: dict[tuple[str, int], list[int]]) -> Iterator[Rule]:
    return (r for r, _ in moves(rule, schema, constants))


def generalizations(rule: Rule) -> Iterator[Rule]:
    for a, atom in enumerate(rule.atoms):
        for i, arg in enumerate(atom.args):
            if arg is not None:
                yield rule.generalize((a, i))


class Pruner:
    """What a search of one relation's rules has seen: duplicates of this search, and rules of too little
    coverage, whose specializations can't have more."""

    def __init__(self) -> None:
        self.seen: set[tuple] = set()
        self.tabu: dict[tuple, list[Rule]] = {}

    def fresh(self, rule: Rule) -> bool:
        """New, valid and no specialization of a rule of too little coverage."""
        if rule.fingerprint in self.seen:
            return False
        self.seen.add(rule.fingerprint)
        return not rule.invalid and not self.is_tabu(rule)

    def add_tabu(self, rule: Rule) -> None:
        self.tabu.setdefault(self._category(rule), []).append(rule)

    def is_tabu(self, rule: Rule) -> bool:
        have = Counter(b.pred for b in rule.body)
        return any(Counter(dict(cat)) <= have and any(t.generalization_of(rule) for t in rules) for cat, rules in self.tabu.items())

    @staticmethod
    def _category(rule: Rule) -> tuple:
        return tuple(sorted(Counter(b.pred for b in rule.body).items()))
