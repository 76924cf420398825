"""Short texts have several leaves, so that an edit in one can be located."""

import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import fingerprints  # noqa: E402


@pytest.mark.parametrize("seed", range(20))
def test_a_line_of_one_sentence_has_several_leaves(seed):
    words = [f"w{seed}x{i * i}" for i in range(12)]
    text = " ".join(words)
    assert "".join(fingerprints.leaves(text)) == text
    assert len(fingerprints.leaves(text)) > 1
    own, new = fingerprints.Tree(text), fingerprints.Tree(fingerprints.edited(text, "other words stand here instead of these"))
    assert 0 < fingerprints.likeness(own, new) < 1
    assert fingerprints.likeness(own, fingerprints.Tree(" ".join(f"v{w}" for w in words))) == 0


@pytest.mark.parametrize("text", ["", "x", "x" * 5_000, "a b", "日本語 " * 50, "x" * 700 + " y z", "One. Two! Three? four five six seven eight nine ten", "  a  b  " * 30])
def test_leaves_are_the_paragraph(text):
    got = fingerprints.leaves(text)
    assert "".join(got) == text and all(got)


def brute(a: str, b: str) -> float:
    """Dice over all leaves of both texts, without a tree."""
    from collections import Counter

    if a == b:
        return 1.0
    x, y = (Counter(leaf for line in t.split("\n") for leaf in fingerprints.leaves(line)) for t in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


@pytest.mark.parametrize("seed", range(60))
def test_descent_finds_what_brute_force_finds(seed):
    import random

    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(12))) + rng.choice(["", ".", "! x y"]) for _ in range(rng.randrange(60))]
    other = lines[:]
    for _ in range(rng.randrange(6)):
        at = rng.randrange(len(other) + 1)
        other[at : at + rng.randrange(3)] = [rng.choice(lines + ["new line of words"]) for _ in range(rng.randrange(3))]
    a, b = "\n".join(lines), "\n".join(other)
    one, two = fingerprints.Tree(a), fingerprints.Tree(b)
    assert fingerprints.likeness(one, two) == pytest.approx(brute(a, b)) == fingerprints.likeness(two, one)
    again = fingerprints.parse(str(one))
    assert again.sections == one.sections and again.root == one.root
    assert fingerprints.likeness(again, fingerprints.parse(str(two))) == fingerprints.likeness(one, two)
    new = [line for line in other if line not in set(lines)]
    assert len(fingerprints.differing(two, one)) == (0 if a == b else len(new))


def test_long_texts_have_sections_and_an_edit_is_located():
    lines = [f"line {i} has words {i * 7} and more of them" for i in range(400)]
    tree = fingerprints.Tree("\n".join(lines))
    assert 10 < len(tree.sections) < 60
    lines[200] = "an edit"
    other = fingerprints.Tree("\n".join(lines))
    (at,) = fingerprints.differing(other, tree)
    assert sum(len(s[1]) for s in other.sections[: at[0]]) + at[1] == 200
    assert len({s[0] for s in tree.sections} - {s[0] for s in other.sections}) == 1
