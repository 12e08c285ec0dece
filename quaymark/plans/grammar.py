"""Prompt formats as an immutable tree, compiled to columns.

A candidate format is a row of slot values (indices into the domains). One walk of the tree gives the
effective values, one the validity, one the rendered text; no tree is ever copied, and the whole search space
stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaymark.functions.domains import DOMAINS, NUMBERINGS, SIGNS, WRAPPERS, blank, cased, number, wrapped

HOLE = "{}"


@dataclass(frozen=True)
class Owner:
    """A value shared by several components, searchable if its template lists it."""

    name: str
    kind: str
    value: str


@dataclass(frozen=True)
class Bare:
    """A field's text alone."""

    name: str


@dataclass(frozen=True)
class Field:
    """A descriptor, a separator and a field's text."""

    name: str
    descriptor: str
    separator: str = ": "
    casing: str = "identity"
    separator_of: str | None = None
    casing_of: str | None = None
    with_text: bool = True
    output: bool = False


@dataclass(frozen=True)
class Items:
    """An enumeration of fields."""

    name: str
    descriptor: str
    items: tuple[int, ...]
    space: str = " "
    separator: str = " "
    wrapper: str = "({})"
    numbering: str = "arabic"
    gap: str | None = None
    casing: str = "identity"
    separator_of: str | None = None
    wrapper_of: str | None = None
    numbering_of: str | None = None
    casing_of: str | None = None
    output: bool = False


@dataclass(frozen=True)
class Spaced:
    """Components joined by a space value."""

    name: str
    children: tuple["Node", ...]
    space: str = "\n"
    only_blank: bool = False


Node = Bare | Field | Items | Spaced


@dataclass(frozen=True)
class Slot:
    """A value that may be changed: of a component, or of an owner."""

    component: str
    kind: str

    @property
    def column(self) -> str:
        return f"{self.component}__{self.kind}"


@dataclass(frozen=True)
class Template:
    """A task shape: its tree, its owners, which owners are searched, how classes are named, the possible lengths."""

    name: str
    root: Node
    owners: tuple[Owner, ...] = ()
    searched: tuple[str, ...] | None = None
    class_template: str | None = None
    lengths: tuple[int, ...] = ()

    def slots(self) -> list[Slot]:
        """In the order in which values are applied: the tree top down, then the shared values."""
        listed = [o for o in self.owners if self.searched is None or o.name in self.searched]
        return [*_slots(self.root), *(Slot(o.name, o.kind) for o in listed)]

    def size(self) -> int:
        """The number of candidate formats."""
        out = 1
        for s in self.slots():
            out *= len(DOMAINS[s.kind])
        return out


def _slots(node: Node) -> Iterator[Slot]:
    if isinstance(node, Spaced):
        yield Slot(node.name, "space")
        for c in node.children:
            yield from _slots(c)
    elif isinstance(node, Field):
        if node.separator_of is None:
            yield Slot(node.name, "separator")
        if node.casing_of is None and node.descriptor:
            yield Slot(node.name, "casing")
    elif isinstance(node, Items):
        yield Slot(node.name, "space")
        for kind in ("separator", "wrapper", "numbering"):
            if getattr(node, f"{kind}_of") is None:
                yield Slot(node.name, kind)
        if node.descriptor:
            if node.casing_of is None:
                yield Slot(node.name, "casing")
            yield Slot(node.name, "gap")


def walk(node: Node) -> Iterator[Node]:
    yield node
    for c in node.children if isinstance(node, Spaced) else ():
        yield from walk(c)


def _pick(values: tuple[str, ...] | list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index + 1)


class Compiled:
    """The columns of a template over rows that hold its slots' indices (``named``: at another name).

    ``original`` compiles the template's own values, which need not lie in the domains.
    """

    def __init__(self, template: Template, original: bool = False, prefix: str = "") -> None:
        self.template, self.prefix = template, prefix
        self.given = {} if original else {(s.component, s.kind): F.col(prefix + s.column) for s in template.slots()}
        self.owner = {o.name: o for o in template.owners}

    def _value(self, component: str, kind: str, default: str) -> Column:
        index = self.given.get((component, kind))
        return F.lit(default) if index is None else _pick(DOMAINS[kind], index)

    def _of(self, node: Field | Items, kind: str) -> Column:
        shared = getattr(node, f"{kind}_of", None)
        if shared is not None:
            return self._value(shared, kind, self.owner[shared].value)
        return self._value(node.name, kind, getattr(node, kind))

    def space(self, node: Spaced | Items) -> Column:
        return self._value(node.name, "space", node.space)

    def separator(self, node: Field | Items) -> Column:
        """After silent refusals: an own empty separator, or one whose line break the items' space doesn't have, leaves the old one."""
        new = self._of(node, "separator")
        if node.separator_of is not None or (node.name, "separator") not in self.given:
            return new
        if isinstance(node, Field):
            return F.when(new == "", F.lit(node.separator)).otherwise(new)
        return F.when(_breaks(new) & ~_breaks(self.space(node)), F.lit(node.separator)).otherwise(new)

    def valid(self) -> Column:
        """A conjunction of simple conditions, so that those on one slot are pushed below a product of slots."""
        out = [F.lit(True)]
        for node in walk(self.template.root):
            if isinstance(node, Field):
                out.append(self.separator(node) != "")
            elif isinstance(node, Items):
                if node.separator_of is not None:
                    out.append(~_breaks(self.separator(node)) | _breaks(self.space(node)))
                most = max((*node.items, *(n - 1 for n in self.template.lengths[-1:])), default=0)
                if most >= SIGNS:
                    out.append(self._of(node, "numbering") != "numeral_sign")
            elif isinstance(node, Spaced):
                new = self.space(node)
                if node.only_blank:
                    out.append(new.isin([s for s in DOMAINS["space"] if blank(s)]) if (node.name, "space") in self.given else F.lit(blank(node.space)))
                if not all(isinstance(c, Field) and not c.with_text for c in node.children[:-1]):
                    out.append(new != "")
        out += self._inherited(self.template.root, None)
        first, *rest = out
        for c in rest:
            first = first & c
        return first

    def _inherited(self, node: Node, allowed: Column | None) -> list[Column]:
        """Below a space without a line break, no separator may have one."""
        out: list[Column] = []
        if isinstance(node, Spaced):
            own = _breaks(self.space(node))
            below = own if allowed is None else allowed & own
            for c in node.children:
                out += self._inherited(c, below)
        elif isinstance(node, Items) or isinstance(node, Field) and node.with_text:
            if allowed is not None:
                out.append(allowed | ~_breaks(self.separator(node)))
        return out

    def _described(self, node: Field | Items) -> Column:
        shared = node.casing_of
        default = self.owner[shared].value if shared is not None else node.casing
        index = self.given.get((shared or node.name, "casing"))
        forms = cased(node.descriptor)
        return F.lit(forms[DOMAINS["casing"].index(default)]) if index is None else _pick(forms, index)

    def numbered(self, node: Items, i: int) -> Column:
        """The label of item ``i`` without its wrapper."""
        return self._chosen(node, "numbering", [number(s, i) for s in NUMBERINGS], lambda v: number(v, i))

    def _chosen(self, node: Items, kind: str, forms: list[str], of) -> Column:
        shared = getattr(node, f"{kind}_of")
        default = self.owner[shared].value if shared is not None else getattr(node, kind)
        index = self.given.get((shared or node.name, kind))
        return F.lit(of(default)) if index is None else _pick(forms, index)

    def item(self, node: Items, i: int) -> Column:
        """Descriptor, gap and wrapped label of an item."""
        shared = node.wrapper_of
        default = self.owner[shared].value if shared is not None else node.wrapper
        index = self.given.get((shared or node.name, "wrapper"))
        label = self.numbered(node, i)
        if index is None:
            left, right = default.split(HOLE)
            label = F.concat(F.lit(left), label, F.lit(right))
        else:
            sides = [w.split(HOLE) for w in WRAPPERS]
            label = F.concat(_pick([s[0] for s in sides], index), label, _pick([s[1] for s in sides], index))
        gap = self._value(node.name, "gap", node.gap if node.gap is not None else " " if node.descriptor else "")
        return F.concat(self._described(node), gap, label)

    def render(self, with_output: bool = True, length: int | None = None, text: str = HOLE) -> Column:
        """The format with ``text`` at each field; without outputs the text of an output field is left out."""
        return self._render(self.template.root, with_output, length, text)

    def _render(self, node: Node, with_output: bool, length: int | None, text: str) -> Column:
        if isinstance(node, Bare):
            return F.lit(text)
        if isinstance(node, Field):
            shown = text if node.with_text and (with_output or not node.output) else ""
            return F.concat(self._described(node), self.separator(node), F.lit(shown))
        if isinstance(node, Items):
            shown = text if with_output or not node.output else ""
            parts = [F.concat(self.item(node, i), self.separator(node), F.lit(shown)) for i in node.items[:length]]
            return _joined(parts, self.space(node))
        return _joined([self._render(c, with_output, length, text) for c in node.children], self.space(node))

    def _enumerations(self) -> list[tuple[str, Items]]:
        """The last enumeration, whose items may be the answer, is 'enum1', one before it 'enum0'."""
        found = [n for n in walk(self.template.root) if isinstance(n, Items)]
        return [(f"enum{1 - k}", n) for k, n in enumerate(reversed(found))][:2][::-1]

    def enumeration_names(self) -> list[tuple[str, Column]]:
        """('enum1_1', label) for every item of the enumerations that an instruction may name."""
        return [(f"{e}_{k}", self.numbered(n, i)) for e, n in self._enumerations() for k, i in enumerate(n.items, 1)]

    def classes(self) -> Column:
        """The class names under the template's class pattern, one per item of the enumeration 'enum1'; the wrapper and the casing don't count."""
        options = dict(self._enumerations())["enum1"]
        left, right = (self.template.class_template or "{enum1}").split("{enum1}")
        return F.array(*(F.concat(F.lit(left), self.numbered(options, i), F.lit(right)) for i in options.items))


def _breaks(value: Column) -> Column:
    return F.contains(value, F.lit("\n"))


def _joined(parts: list[Column], space: Column) -> Column:
    out = [parts[0]]
    for p in parts[1:]:
        out += [space, p]
    return F.concat(*out)


def evaluate(template: Template, spark, original: bool = True) -> str:
    """The original format as text."""
    return spark.range(1).select(Compiled(template, original=original).render().alias("node")).first()[0]


__all__ = ["Bare", "Compiled", "Field", "Items", "Node", "Owner", "Slot", "Spaced", "Template", "walk", "wrapped"]
