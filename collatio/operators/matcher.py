"""Matching the blocks of two versions of a document, one-to-one and in reading order.

``match_pairs`` runs the whole cascade for each document pair in one task: the cascade is greedy, an
earlier left block takes its partner before a later one looks, so it has no relational form. Pairs are independent,
and memory is bounded by one pair. For pairs too large for a task there are the staged operators of ``matching``.

The cascade is a list of stages; each proposes partners for one left block and says whether the search ends there.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions.aligned import tokens_of
from ..functions.contacts import contact
from ..functions.aligned import best_window
from ..functions.lexicon import DEFAULT, STRICT_ROLES, Lexicon
from ..lineage import met_in_place


@dataclass(frozen=True)
class Profile:
    """Thresholds by target."""

    target: str = "html"
    proofread: bool = False

    @property
    def approx(self) -> float:
        return 0.73 if self.target == "html" else 0.78 if self.proofread else 0.74

    @property
    def group_floor(self) -> float:
        # pages have lower floors, but groups are paired from .90 (quotes) and .88 (footnotes) on anyway
        return 0.9 if self.target == "html" else 0.88


TABLE_FLOOR, CONTEXT_FLOOR, ROW_FLOOR, LENGTH_RATIO = 2.4, 0.8, 0.94, 0.45
#: Headers of one section pair from this likeness on.
SECTION_FLOOR = 0.6


@dataclass
class Block:
    order: int
    text: str
    heading: bool = False
    heading_level: int | None = None
    bold: bool = False
    italic: bool = False
    underline: bool = False
    list_item: bool = False
    table_cell: bool = False
    kind: str = "p"
    table: int | None = None
    row: int | None = None
    col: int | None = None
    row_key: str | None = None
    row_slot: int | None = None
    numeric_slot: int | None = None
    footnote_marker: str | None = None
    role: str = ""
    family: int | None = None
    runs: list[dict] | None = None
    norm: str = field(init=False)
    token: dict | None = field(init=False)
    numeric: bool = field(init=False)

    def __post_init__(self) -> None:
        self.text = self.text or ""
        self.norm = s.key_of(self.text)
        self.token = s.only_token(self.text)
        self.numeric = self.token is not None and self.token["kind"] == "number"

    @property
    def place(self) -> tuple[int, int, int] | None:
        return (self.table, self.row, self.col) if self.table_cell and self.table is not None else None

    @property
    def table_index(self) -> int | None:
        return self.family if self.family is not None else self.table if self.table_cell else None


def roles_fit(a: Block, b: Block) -> bool:
    return not a.role or not b.role or a.role == b.role or not {a.role, b.role} & set(STRICT_ROLES)


def styled_tokens(b: Block, style: str) -> Counter:
    """The tokens of a block's runs that show a style; runs next to each other are read as one text."""
    shows = lambda r: bool(r[style] or (style == "underline" and r["hyperlink"]))
    texts = ("".join(r["text"] for r in some) for shown, some in groupby(b.runs or (), shows) if shown)
    return Counter(t["normalized"] for text in texts for t in tokens_of(text))


def formatting_score(a: Block, b: Block) -> float:
    """How alike two blocks look: equal traits add, different ones take off."""
    total = 0.0
    if a.role and b.role:
        total += 2.0 if a.role == b.role else -1.25
    for same, plus, minus in ((a.heading == b.heading, 2.0, 1.0), (a.list_item == b.list_item, 1.0, 0.5), (a.table_cell == b.table_cell, 1.5, 0.75), (a.kind == b.kind, 0.5, 0.0)):
        total += plus if same else -minus
    if a.heading and b.heading and a.heading_level == b.heading_level:
        total += 0.5
    for style in ("bold", "italic", "underline"):
        alike = getattr(a, style) == getattr(b, style)
        if a.runs and b.runs:
            total += 1.25 if styled_tokens(a, style) == styled_tokens(b, style) else 0.4 if alike else -0.5
        else:
            total += 0.8 if alike else -0.5
    return total


def context_score(a: Block, b: Block) -> float:
    """Likeness of two cells in the same context; numbers by value."""
    if s.key_of(s.no_lead(a.text)) == s.key_of(s.no_lead(b.text)):
        return 1.0
    score = s.alike(a.norm, b.norm)
    if a.token and b.token and a.token["kind"] == b.token["kind"]:
        if a.token["normalized"] == b.token["normalized"]:
            return 1.0
        return max(score, s.number_match(a.token["text"], b.token["text"]) if a.numeric else 0.8)
    return score


@dataclass
class Family:
    table: int
    first: int
    rows: list[str]
    headers: list[str]
    titles: list[str]
    numbers: int

    @property
    def comparable(self) -> bool:
        return len(self.rows) >= 2 and (self.numbers >= 2 or len(self.headers) >= 3)


def unique(values, most: int | None = None) -> list[str]:
    """The first of equal values that say something, ``most`` at most."""
    found: dict[str, None] = {}
    for v in values:
        if v:
            found[v] = None
            if len(found) == most:
                break
    return list(found)


def families(blocks: list[Block]) -> list[Family]:
    by_table: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(blocks):
        if b.table_index is not None:
            by_table[b.table_index].append(i)
    out = []
    for table, at in sorted(by_table.items()):
        own, titles = [blocks[i] for i in at], []
        for b in reversed(blocks[: at[0]]):
            if b.table_cell or len(titles) == 3:
                break
            if s.visible_text(s.alnum_of(b.text)):
                titles.insert(0, s.alnum_of(b.text))
        headers = unique((s.alnum_of(b.text) for b in own if not b.numeric and s.visible_text(b.text)), 8)
        out.append(Family(table, at[0], unique(b.row_key for b in own), headers, titles, sum(b.numeric_slot is not None for b in own)))
    return out


def share(a: list[str], b: list[str]) -> float:
    return len(set(a) & set(b)) / max(len(set(a)), len(set(b))) if a and b else 0.0


def family_score(a: Family, b: Family, ranks: tuple[int, int]) -> float:
    part = lambda x, y: min(x, y) / max(x, y, 1)
    title = max((s.alike(x, y) for x in a.titles for y in b.titles), default=0.0)
    near = 1.0 - min(1.0, abs(ranks[0] - ranks[1]) * 0.5)
    return 6 * share(a.rows, b.rows) + 2.5 * share(a.headers, b.headers) + 2 * title + 0.75 * part(len(a.rows), len(b.rows)) + 0.75 * part(a.numbers, b.numbers) + 0.5 * near


def align_tables(left: list[Block], right: list[Block]) -> dict[int, int]:
    """Left table to right table, greedily from the best score down; among equal scores nearer and earlier tables."""
    a, b = ([f for f in families(x) if f.comparable] for x in (left, right))
    scored = [(family_score(f, g, (i, j)), i, j) for i, f in enumerate(a) for j, g in enumerate(b)]
    out: dict[int, int] = {}
    for score, i, j in sorted(scored, key=lambda t: (-t[0], abs(t[1] - t[2]), a[t[1]].table, b[t[2]].table)):
        if score >= TABLE_FLOOR and a[i].table not in out and b[j].table not in out.values():
            out[a[i].table] = b[j].table
    return out


@dataclass
class Group:
    kind: str
    members: list[int]
    key: object
    marker: str | None = None


def groups(blocks: list[Block], lexicon: Lexicon = DEFAULT) -> list[Group]:
    """Contact runs (a label and up to five lines after it), quotes and footnotes, in reading order."""
    out: list[Group] = []
    i = 0
    while i < len(blocks):
        b, here = blocks[i], i
        i += 1
        if label := contact(b.text, lexicon).label:
            members = [here]
            while i < len(blocks) and len(members) < 6 and not blocks[i].table_cell and not blocks[i].heading and not contact(blocks[i].text, lexicon).label and contact(blocks[i].text, lexicon).like:
                members.append(i)
                i += 1
            out.append(Group("contact", members, label))
        elif not b.table_cell and not b.heading and (quote := s.quote_parts(b.text)):
            out.append(Group("quote", [here], quote))
        elif (b.kind == "footnote" or (b.table_cell and len(b.norm) > 80 and b.text[:1].isdigit())) and (key := s.no_refs(b.text)):
            out.append(Group("footnote", [here], key, b.footnote_marker or s.marker_of(b.text)))
    return out


def quote_text(q) -> str:
    return "|".join([*q[:4], "1" if q[4] else "0"])


def group_score(a: Group, b: Group) -> float:
    if a.kind != b.kind:
        return 0.0
    if a.kind == "contact":
        return float(a.key == b.key)
    if a.kind == "footnote":
        text = s.alike(a.key, b.key)
        return max(text, 0.96) if a.marker is not None and a.marker == b.marker and s.overlap(a.key, b.key) >= 0.45 else text
    if a.key == b.key:
        return 1.0
    key = s.alike(quote_text(a.key), quote_text(b.key))
    pair = [s.alike(x, y) if x and y else 0.0 for x, y in zip(a.key[1:3], b.key[1:3], strict=True)]
    lead = s.overlap(a.key[3], b.key[3]) if a.key[3] and b.key[3] else 0.0
    same_role = bool(a.key[0]) and a.key[0] == b.key[0]
    for holds, least in (
        (same_role and (a.key[4] or b.key[4]), 0.95), (same_role and pair[0] >= 0.92 and pair[1] >= 0.72, 0.98), (same_role and max(pair) >= 0.62, 0.93), (pair[0] >= 0.9 and lead >= 0.45, 0.92),
    ):
        if holds:
            return max(key, least)
    return key


GROUP_PAIR_FLOOR = {"contact": 1.0, "quote": 0.9, "footnote": 0.88}


def pair_groups(a: list[Group], b: list[Group]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, g in enumerate(a):
        best = max(((group_score(g, h), -j) for j, h in enumerate(b) if j not in out.values()), default=(0.0, 0))
        if best[0] >= GROUP_PAIR_FLOOR[g.kind]:
            out[i] = -best[1]
    return out


def containment(a: Block, b: Block) -> float:
    if not a.norm or not b.norm or a.table_cell:
        return 0.0
    if a.norm in b.norm:
        return 0.99
    f, c = list(s.bag_of(a.norm)), list(s.bag_of(b.norm))
    if len(f) <= 4:
        score = best_window(f, c)
        return score if score >= 0.9 else 0.0
    part = s.overlap(a.norm, b.norm)
    if len(f) >= 8 and part >= 0.94:
        return 0.9 + min(0.09, (part - 0.94) * 1.5)
    return 0.84 + min(0.05, (part - 0.88) * 1.2) if len(f) >= 20 and part >= 0.88 else 0.0


class Matcher:
    def __init__(self, left: list[Block], right: list[Block], profile: Profile, lexicon: Lexicon = DEFAULT):
        self.left, self.right, self.profile, self.lexicon = left, right, profile, lexicon
        self.tables = align_tables(left, right)
        self.groups = groups(left, lexicon), groups(right, lexicon)
        self.pairs = pair_groups(*self.groups)
        self.group_of = [{i: k for k, g in enumerate(side) for i in g.members} for side in self.groups]
        self.index: dict[str, dict] = {k: defaultdict(list) for k in ("text", "place", "table", "row", "any_row", "any_number", "header", "label")}
        self.ordinals = {}
        for j, b in enumerate(right):
            for name, key in self.keys(b, right, j, False).items():
                if key is not None:
                    self.index[name][key].append(j)
        self.words: dict[str | None, list[int]] | None = None
        self.common: Counter[str] = Counter()
        self.used: set[int] = set()
        self.matches: dict[int, tuple[int, str, float]] = {}
        self.held: set[int] = set()

    def keys(self, b: Block, blocks: list[Block], i: int, mapped: bool) -> dict:
        """What a block is found by; the left side's table numbers are those of the aligned right tables."""
        to = (lambda t: self.tables.get(t, t)) if mapped else (lambda t: t)
        cell = b.table_cell and b.row_key
        return {
            "text": b.norm,
            "place": (to(b.table), b.row, b.col) if b.place else None,
            "table": None if b.table_index is None else to(b.table_index),
            "row": (to(b.table), b.row_key, b.row_slot) if cell and b.table is not None and b.row_slot is not None else None,
            "any_row": (b.row_key, b.row_slot) if cell and b.row_slot is not None else None,
            "any_number": (b.row_key, b.numeric_slot) if cell and b.numeric_slot is not None and b.numeric else None,
            **self.ordinal_keys(blocks, i, to),
        }

    def ordinal_keys(self, blocks: list[Block], i: int, to) -> dict:
        """Where a header stands among its table's headers of its kind, and a row label among the labels."""
        if id(blocks) not in self.ordinals:
            seen: dict = defaultdict(int)
            known = {}
            for k, b in enumerate(blocks):
                kind = {"table_title": "title", "table_subtitle": "title", "table_column_header": "column", "table_row_label": "label"}.get(b.role)
                if kind and b.table_index is not None:
                    known[k] = (kind, b.table_index, seen[b.table_index, kind])
                    seen[b.table_index, kind] += 1
            self.ordinals[id(blocks)] = known
        kind, table, n = self.ordinals[id(blocks)].get(i, (None, None, None))
        return {"header": (to(table), kind, n) if kind in ("title", "column") else None, "label": (to(table), n) if kind == "label" else None}

    def take(self, i: int, j: int, kind: str, score: float, shared: bool = False) -> None:
        self.matches[i] = (j, kind, score)
        if not shared:
            self.used.add(j)

    def promoted(self, i: int, j: int, score: float) -> str:
        """approx, or exact_structural for headers of one section whose following text agrees, and for like leads."""
        a, b = self.left[i], self.right[j]
        if a.role == b.role == "section_header" and score >= 0.78 and (key := s.section_of(a.text, self.lexicon)) and key == s.section_of(b.text, self.lexicon):
            x, y = self.following(self.left, i), self.following(self.right, j)
            if x is None or y is None or s.alike(x.norm, y.norm) >= 0.82:
                return "exact_structural"
        if a.role == b.role == "section_lead" and score >= 0.78:
            x, y = self.following(self.left, i), self.following(self.right, j)
            if x and y and s.alike(x.norm, y.norm) >= 0.9:
                return "exact_structural"
        return "approx"

    @staticmethod
    def following(blocks: list[Block], i: int) -> Block | None:
        return next((b for b in blocks[i + 1 :] if not b.table_cell and b.kind != "footnote" and s.visible_text(b.text)), None)

    def exact(self, i: int, among) -> int | None:
        """The best-looking free block of equal text; none if a repeated label can't be told apart."""
        a = self.left[i]
        free = [j for j in among if j not in self.used and self.right[j].norm == a.norm and roles_fit(a, self.right[j])]
        if len(free) <= 1:
            return free[0] if free else None
        score = {j: formatting_score(a, self.right[j]) for j in free}
        free.sort(key=lambda j: (-score[j], abs(len(a.text) - len(self.right[j].text)), self.right[j].order))
        if s.repeat_key(a.text, self.lexicon):
            shape = [tuple(getattr(a, k) == getattr(self.right[j], k) for k in ("table_cell", "heading", "kind", "role")) for j in free[:2]]
            if shape[0] == shape[1] and abs(score[free[0]] - score[free[1]]) < 1.0:
                return None
        return free[0]

    def best(self, i: int, among: list[int], score) -> tuple[float, int | None]:
        return max(((score(self.left[i], self.right[j]), -j) for j in among), default=(0.0, None)) if among else (0.0, None)

    def prematch(self) -> None:
        """Single numbers in the same cell of aligned tables."""
        for i, a in enumerate(self.left):
            if not a.place or not a.numeric:
                continue
            to = lambda t: self.tables.get(t, t)
            place, table = (to(a.table), a.row, a.col), to(a.table_index)
            fits = [
                j
                for j in self.index["place"].get(place, [])
                if j not in self.used
                and (b := self.right[j]).numeric
                and b.table_index == table
                and not (a.row_key and b.row_key and s.alike(a.row_key, b.row_key) < ROW_FLOOR)
                and all(x is None or y is None or x == y for x, y in ((a.numeric_slot, b.numeric_slot), (a.row_slot, b.row_slot)))
            ]
            if fits:
                j = max(fits, key=lambda j: (s.alike(a.norm, self.right[j].norm), -j))
                same = a.norm == self.right[j].norm
                self.take(i, j, "exact" if same else "approx", 1.0 if same else 0.95)

    def prematch_groups(self) -> None:
        for g, h in ((self.groups[0][k], self.groups[1][m]) for k, m in self.pairs.items()):
            j = h.members[0]
            if j in self.used or g.members[0] in self.matches:
                continue
            if g.kind == "contact":
                parts = contact(self.right[j].text, self.lexicon).parts
                for i in g.members:
                    field_of = contact(self.left[i].text, self.lexicon).value
                    if field_of is None:
                        self.take(i, j, "approx", 0.9)
                    elif field_of[0] not in parts:
                        self.take(i, j, "approx", 0.85)
                    else:
                        self.take(i, j, "exact_structural", max(0.82, s.alike(s.key_of(field_of[1]), s.key_of(parts[field_of[0]]))))
            elif len(h.members) == 1 and (score := group_score(g, h)) >= self.profile.group_floor:
                self.take(g.members[0], j, self.promoted(g.members[0], j, score), score)

    def cascade(self, i: int) -> bool:
        """Whether the left block found a partner, or ended in a stage that neither matches nor reports it."""
        a, find = self.left[i], self.keys(self.left[i], self.left, i, True)
        group = self.group_of[0].get(i)
        target = self.pairs.get(group) if group is not None else None
        own_group = [j for j in range(len(self.right)) if self.group_of[1].get(j) == target] if target is not None else None
        in_group = (lambda j: j in own_group) if own_group is not None else (lambda j: True)
        in_family = (lambda j: self.right[j].table_index == find["table"]) if find["table"] is not None else (lambda j: True)

        def candidates(name: str, family: bool) -> list[int]:
            found = self.index[name].get(find[name], []) if find[name] is not None else []
            return [j for j in found if j not in self.used and in_group(j) and (not family or in_family(j))]

        def settle(j: int | None) -> bool:
            if j is not None:
                self.take(i, j, "exact", 1.0)
            return j is not None

        at_place = candidates("place", False)
        if settle(self.exact(i, at_place)):
            return True
        for name, ends in (("any_number", True), ("row", True), ("any_row", False)):
            among = candidates(name, True)
            if settle(self.exact(i, among)):
                return True
            score, j = self.best(i, among, context_score)
            if j is not None and score >= CONTEXT_FLOOR:
                self.take(i, -j, self.promoted(i, -j, score), score)
                return True
            if among and ends:
                self.held.add(i)  # candidates stood here but none was near enough
                return True
        if a.table_cell and a.row_key:
            slot = (lambda b: b.numeric_slot == a.numeric_slot) if a.numeric_slot is not None else (lambda b: a.row_slot is not None and b.row_slot == a.row_slot)
            among = [j for j, b in enumerate(self.right) if j not in self.used and b.table_cell and b.row_key and in_family(j) and in_group(j) and slot(b) and s.alike(a.row_key, b.row_key) >= ROW_FLOOR]
            score, j = self.best(i, among, context_score)
            if j is not None and score >= CONTEXT_FLOOR:
                self.take(i, -j, self.promoted(i, -j, score), score)
                return True
        if find["table"] is not None and not at_place and settle(self.exact(i, candidates("table", False))):
            return True
        if (find["table"] is None or (a.token is None and len(a.norm) >= 12)) and settle(self.exact(i, candidates("text", True))):
            return True
        floor = self.profile.approx
        score, j = self.nearest(i, find, in_group, min(floor, SECTION_FLOOR) if a.role == "section_header" else floor)
        if j is not None:
            b = self.right[-j]
            if a.role == b.role == "section_header" and (key := s.section_of(a.text, self.lexicon)) and key == s.section_of(b.text, self.lexicon):
                floor = min(floor, SECTION_FLOOR)
            if score >= floor:
                self.take(i, -j, self.promoted(i, -j, score), score)
                return True
        return False

    def nearest(self, i: int, find: dict, in_group, least: float) -> tuple[float, int | None]:
        """The most alike free block of the cell, else of the table, else of all blocks of fitting role and length.

        Of all blocks those that can't be as alike as ``least``, or as the best so far, are passed over: words make up
        half of the likeness, pairs of letters 0.35 and lengths 0.15.
        """
        for name in ("place", "table"):
            if find[name] is not None and find[name] in self.index[name]:
                return self.best(i, [j for j in self.index[name][find[name]] if j not in self.used and in_group(j)], lambda x, y: s.alike(x.norm, y.norm))
        a, size = self.left[i], max(len(self.left[i].norm), 1)
        bag, likely = set(s.bag_of(a.norm)), []
        for j in self.sharing(bag, 2 * least - 1):
            b = self.right[j]
            lengths = min(size, len(b.norm)) / max(size, len(b.norm)) if b.norm else 1 / size
            if lengths < LENGTH_RATIO or not in_group(j) or not roles_fit(a, b):
                continue
            other = set(s.bag_of(b.norm))
            words = len(bag & other) / len(bag | other) if bag else 1.0
            most = 0.5 * words + 0.35 + 0.15 * lengths + 1e-9
            if most >= least:
                likely.append((-most, j))
        found: tuple[float, int | None] = (0.0, None)
        for most, j in sorted(likely):
            if -most < found[0]:
                break
            score = s.alike(a.norm, self.right[j].norm)
            if found[1] is None or (score, -j) > found:
                found = (score, -j)
        return found

    def sharing(self, bag: set[str], part: float) -> set[int]:
        """The free blocks with no words if there are none, else at least those that share so great a part of all words of both."""
        if self.words is None:
            # blocks stand under the words that they are found by at the least part that is asked for
            lowest = 2 * min(self.profile.approx, SECTION_FLOOR if any(b.role == "section_header" for b in self.left) else 1.0) - 1
            bags = {j: set(s.bag_of(b.norm)) for j, b in enumerate(self.right) if j not in self.used}
            self.common = Counter(chain.from_iterable(bags.values()))
            self.words = defaultdict(list)
            for j, own in bags.items():
                for word in self.telling(own, lowest):
                    self.words[word].append(j)
        out: set[int] = set()
        for word in self.telling(bag, part):
            if word in self.words:
                self.words[word] = [j for j in self.words[word] if j not in self.used]
                out.update(self.words[word])
        return out

    def telling(self, bag: set[str], part: float) -> list[str | None]:
        """The rarest words of a bag: two bags that share so great a part of all their words share one of these.

        Such bags share that part of each of them, and the rarest word that they share has no more rarer ones beside it
        than the rest of either bag.
        """
        if not bag:
            return [None]
        return sorted(bag, key=lambda w: (self.common[w], w))[: len(bag) - math.ceil(part * len(bag) - 1e-9) + 1]

    def recover(self, name: str) -> None:
        """Headers and row labels left over, by their ordinal in the aligned table."""
        for i, a in enumerate(self.left):
            if i in self.matches or i in self.held:
                continue
            key = self.ordinal_keys(self.left, i, lambda t: self.tables.get(t, t))[name]
            free = [j for j in self.index[name].get(key, []) if j not in self.used] if key is not None else []
            if len(free) != 1:
                continue
            b = self.right[free[0]]
            score = s.alike(a.norm, b.norm)
            if name == "header":
                score = max(score, formatting_score(a, b) / 10)
                if score >= (0.6 if key[1] == "title" else 0.72):
                    self.take(i, free[0], "exact_structural", score)
            elif score >= 0.62 or (a.row_key and b.row_key and s.alike(a.row_key, b.row_key) >= 0.62):
                self.take(i, free[0], "exact_structural" if score >= 0.82 else "approx", max(score, 0.82) if score >= 0.62 else score)

    def contained(self) -> None:
        """Left-over blocks of pages that hold several left blocks."""
        loose = [i for i in range(len(self.left)) if i not in self.matches and i not in self.held]
        for j in [j for j in range(len(self.right)) if j not in self.used]:
            b = self.right[j]
            if b.table_cell or (b.kind != "pdf" and len(b.norm) < 40 and "\n" not in b.text):
                continue
            found = [(i, x) for i in loose if i not in self.matches and (x := containment(self.left[i], b)) >= 0.88]
            sizes = [len(self.left[i].norm) / max(len(b.norm), 1) for i, _ in found]
            if found and (len(found) >= 3 or sum(sizes) >= 0.42 or max(sizes) >= 0.6):
                for i, x in found:
                    self.take(i, j, "contained", x)

    def run(self) -> dict[int, tuple[int, str, float]]:
        self.prematch()
        self.prematch_groups()
        for i in range(len(self.left)):
            if i not in self.matches:
                self.cascade(i)
        self.recover("header")
        self.recover("label")
        if self.profile.target == "pdf":
            self.contained()
        return self.matches


#: Columns of blocks as they come in, and what stands where one is null.
BLOCK_COLUMNS = ("order", "text", "heading", "heading_level", "bold", "italic", "underline", "list_item", "table_cell", "kind", "table", "row", "col", "row_key", "row_slot", "numeric_slot", "footnote_marker", "structure_role", "family_table_index", "runs")
EMPTY = {"text": "", "heading": False, "bold": False, "italic": False, "underline": False, "list_item": False, "table_cell": False, "kind": "p", "structure_role": ""}
#: What else is known of a block, for its comments.
SEEN = ("row_symbol", "currency")
MATCHES = "pair_id long, left_order int, right_order int, match_type string, score double, held boolean, group_type string"
#: As MATCHES, with rows that are comments on sections and near matches, and one-sided blocks that these cover.
NOTED = MATCHES + ", contents string, covered boolean"
#: As NOTED, with the comments of matches (seq tells them from the others) and matches that need a page's segment first.
EXPLAINED = NOTED + ", seq int, token_index int, focus boolean"
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
#: Pairs of a batch that are read into Python at once.
PAIRS_READ = 64

Seen = tuple[str | None, str | None]


def read_side(lists: pa.Array) -> Iterator[tuple[list[Block], dict[int, Seen]]]:
    """The blocks of each pair, in their order, and by their order what else is known of them."""
    flat = lists.flatten()
    held = {f.name: c for f, c in zip(flat.type, flat.flatten(), strict=True) if c.null_count < len(c)}

    def values(name: str) -> list:
        if name not in held:
            return [EMPTY.get(name)] * len(flat)
        found = held[name].to_pylist()
        return [EMPTY[name] if v is None else v for v in found] if name in EMPTY and held[name].null_count else found

    rows = zip(*map(values, BLOCK_COLUMNS), strict=True)
    seen = zip(*(values(k) for k in SEEN), strict=True)
    for n in pc.list_value_length(lists).to_pylist():
        own = [(Block(*r), more) for r, more in zip(islice(rows, n), islice(seen, n), strict=True)]
        own.sort(key=lambda x: x[0].order)
        yield [b for b, _ in own], {b.order: more for b, more in own}


def match_pairs(left: DataFrame, right: DataFrame, profile: Profile = Profile(), lexicon: Lexicon = DEFAULT) -> DataFrame:  # noqa: B008
    """Full outer result: matches, and blocks of one side only with the other order null.

    held: left blocks that stood in a table context without a near enough partner; they are neither matched nor
    reported as missing. group_type: of left blocks in a matched contact, quote or footnote.
    """
    return _matched(left, right, profile, lexicon, MATCHES)


def match_and_note(left: DataFrame, right: DataFrame, profile: Profile = Profile(), lexicon: Lexicon = DEFAULT) -> DataFrame:  # noqa: B008
    """As ``match_pairs``, with comments on sections and on near matches of left-over blocks."""
    return _matched(left, right, profile, lexicon, NOTED)


def match_and_explain(left: DataFrame, right: DataFrame, profile: Profile = Profile(), lexicon: Lexicon = DEFAULT) -> DataFrame:  # noqa: B008
    """As ``match_and_note``, with the comments of matches and of right blocks alone, made where the blocks are at hand.

    focus: matches of pages whose right text has several lines; the best segment is to be found before they are explained.
    """
    return _matched(left, right, profile, lexicon, EXPLAINED)


def _matched(left: DataFrame, right: DataFrame, profile: Profile, lexicon: Lexicon, schema: str) -> DataFrame:
    from .diff import explain, shorten
    from .sections import near_matches, notes

    page, noting, explaining = profile.target == "pdf", schema != MATCHES, schema == EXPLAINED

    def one(pair: int, x: list[Block], y: list[Block], x_seen: dict, y_seen: dict) -> Iterator[tuple]:
        m = Matcher(x, y, profile, lexicon)
        found = m.run()
        taken = {j for j, _, _ in found.values()}
        group = {i: m.groups[0][g].kind for i, g in m.group_of[0].items() if g in m.pairs}
        told, covered, settled = [], set(), set()
        if noting:
            loose = [i for i in range(len(x)) if i not in found and i not in m.held]
            told, covered = notes(x, y, set(loose), profile.target, shorten, lexicon)
            if not page:
                near, settled = near_matches(x, y, loose, [j for j in range(len(y)) if j not in taken], profile, explain, lexicon)
                told += [(None, order, said) for order, said in near]
        more = (None, None, False)
        for i, (j, kind, score) in found.items():
            a, b, of = x[i], y[j], group.get(i)
            focus = explaining and page and not a.table_cell and not b.table_cell and of != "quote" and "\n" in b.text
            yield pair, a.order, b.order, kind, float(score), False, of, None, False, None, None, focus
            if explaining and not focus:
                (p, ours), (q, theirs) = x_seen[a.order], y_seen[b.order]
                for seq, (said, at) in enumerate(explain(a, b, float(score), kind, of, profile, lexicon, (p, q), (ours, theirs), (a.runs or [], b.runs or []))):
                    yield pair, None, b.order, None, None, False, None, said, False, seq, at, False
        for i, b in enumerate(x):
            if i not in found:
                yield pair, b.order, None, None, None, i in m.held, None, None, i in covered, *more
        for j, b in enumerate(y):
            if j not in taken:
                yield pair, None, b.order, None, None, False, None, None, j in settled, *more
                if explaining and not page and j not in settled and s.visible_text(b.text):
                    yield pair, None, b.order, None, None, False, None, "This HTML block has no corresponding content in the DOCX.", False, 1_000_000, 0, False
        for p, q, said in told:
            yield pair, p, q, None, None, False, None, said, False, *more

    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS_READ):
                batch = whole.slice(at, PAIRS_READ)
                sides = zip(batch.column(0).to_pylist(), read_side(batch.column(1)), read_side(batch.column(2)), strict=True)
                rows = [r for pair, (x, x_seen), (y, y_seen) in sides for r in one(pair, x, y, x_seen, y_seen)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(columns, types, strict=False)], list(names))

    return met_sides(left, right).mapInArrow(all_of, schema)


def met_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, l, r): the blocks of both sides of a pair, in one row; many pairs travel in one batch.

    Sides that are dealt by pair are put together where they lie.
    """
    met_in_place(left, right)
    block = lambda d: F.struct(*[F.col(c) for c in (*BLOCK_COLUMNS, *SEEN) if c in d.columns])
    none = lambda d: F.lit(None).cast(d.select(block(d).alias("b")).schema["b"].dataType)
    pair = F.col("pair_id").cast("long").alias("pair_id")
    # both sides may come from one table; new names of the columns tell them apart
    other = right.toDF(*right.columns)
    both = left.select(pair, block(left).alias("l"), none(right).alias("r")).unionAll(other.select(pair, none(left).alias("l"), block(other).alias("r")))
    return both.groupBy("pair_id").agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))
