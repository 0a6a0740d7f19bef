"""The approximate stage of the cascade finds the most alike of all blocks, however many there are."""

import random

import pytest

from collatio.functions import scalar as s
from collatio.operators.matcher import Block, Matcher, Profile, roles_fit


@pytest.mark.parametrize("profile", [Profile(), Profile("html", True), Profile("pdf", True)])
def test_partner_behind_many_candidates(profile):
    """Over 200 blocks of about the same length share the first words, and the partner stands last."""
    said = "the revenue of the company rose in the quarter to {} million as {} and {} sold well in the region"
    right = [Block(k, said.replace("rose", "was seen").format(k, f"goods{k}", f"parts{k}"), role="paragraph") for k in range(300)]
    right.append(Block(300, said.format(7, "apples", "pears") + " too", role="paragraph"))
    left = [Block(0, said.format(7, "apples", "pears"), role="paragraph")]
    assert Matcher(left, right, profile).run()[0][:2] == (300, "approx")


def test_partner_with_other_first_words_and_length():
    same = " ".join(f"word{k}" for k in range(30))
    right = [Block(0, "nothing of the kind is said here"), Block(1, f"in other news it was told today that {same}")]
    assert Matcher([Block(0, f"yesterday evening {same}")], right, Profile()).run()[0][:2] == (1, "approx")


@pytest.mark.parametrize("roles", [("paragraph",), ("paragraph", "section_header", "list_item", "")])
def test_the_most_alike_of_all_blocks(roles):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(12)] + ["é", "–", "a"]
    some = lambda k: Block(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12]))), role=rng.choice(roles))
    told = 0
    for _ in range(60):
        left, right = [some(k) for k in range(25)], [some(k) for k in range(40)]
        m = Matcher(left, right, Profile())
        m.used = set(rng.sample(range(40), 5))
        for i, a in enumerate(left):
            least = 0.6 if a.role == "section_header" else 0.73
            size = lambda b: max(len(b.norm), 1)
            free = [j for j, b in enumerate(right) if j not in m.used and roles_fit(a, b) and min(size(a), size(b)) >= 0.45 * max(size(a), size(b))]
            want = max(((s.alike(a.norm, right[j].norm), -j) for j in free), default=(0.0, None))
            got = m.nearest(i, m.keys(a, left, i, True), lambda j: True, least)
            if want[0] >= least or got[0] >= least:
                assert got == want
                told += 1
                m.used.add(-want[1])
    assert told > 100


def test_left_over_page_blocks_hold_all_their_lines():
    """A page's block meets every left-over block, and a page has as many such blocks as it has."""
    line = lambda k: f"line {k} tells of item{k} and of thing{k * 7} in place{k * 13}"
    left = [Block(k, line(k)) for k in range(900)]
    right = [Block(n, "\n".join(line(k) for k in range(300 * n, 300 * n + 300)), kind="pdf") for n in range(3)]
    assert {i: j for i, (j, kind, _) in Matcher(left, right, Profile("pdf", True)).run().items() if kind == "contained"} == {k: k // 300 for k in range(900)}


def test_lines_of_a_long_page_find_their_partners():
    """Each of 600 edited lines of one length and beginning meets its own."""
    said = lambda k, end: f"the report of the quarter says of unit{k} that its goods{k * 3} and parts{k * 5} sold {end}"
    left, right = ([Block(k, said(k, end), role="paragraph") for k in order] for end, order in (("well", range(600)), ("badly", range(599, -1, -1))))
    assert {i: 599 - j for i, (j, _, _) in Matcher(left, right, Profile("pdf", True)).run().items()} == {k: k for k in range(600)}
