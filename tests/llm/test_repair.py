"""Conversation repair against a plain search over whole audits."""

import hashlib
import itertools
import random
import re

import pytest

from corpuskiln.llm.repair import audit, audits, repaired

TURNS = "conv_id long, turn long, role string, text string"
NEXT = {("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("0", "s"): "s"}


def cheapest(rows):
    """rows: (initial, fault). All states' least (cost, audit, roles), turn by turn, with insertions wherever they help."""
    best = {"0": (0, "", "")}

    def widened(states):
        for _ in range(3):
            for p, (c, e, r) in list(states.items()):
                for letter in "ua":
                    if (p, letter) in NEXT:
                        q = NEXT[p, letter]
                        states[q] = min(states.get(q, (10**9,)), (c + 5, e + "I", r + letter.upper()))
        return states

    for initial, fault in rows:
        new = {}
        for p, (c, e, r) in widened(best).items():
            ways = [(p, c + 2, e + "D", r + "-")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                ways += [(NEXT[p, x], c + 1 + more, e + "R", r + x) for x in "ua" if (p, x) in NEXT]
                if (p, initial) in NEXT:
                    ways.append((NEXT[p, initial], c + more, e + "K", r + "k"))
            for q, *way in ways:
                new[q] = min(new.get(q, (10**9,)), tuple(way))
        best = new
    return min(v for k, v in widened(best).items() if k in "0a")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        out.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def brute(rows):
    """rows: conv_id, turn, role, text."""
    out = []
    rows = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        own = [r[1:] for r in group]
        faults = faults_of(own)
        cost, edits, marks = cheapest(faults)
        turns = {t for t, _, _ in own if t is not None}
        said, k = [], 0
        names = {"u": "user", "a": "assistant"}
        for mark in marks:
            if mark in "UA":
                said.append(f"{names[mark.lower()]}:")
                continue
            if mark != "-":
                said.append(f"{own[k][1] if mark == 'k' else names[mark]}:{own[k][2]}")
            k += 1
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(faults, faults[1:], strict=False))
        counts = [sum(f == kind for _, f in faults) for kind in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("letters", ["suaxd", "suaSUAXxd", "uaUd"])
def test_audits_of_all_short_conversations(letters):
    fault = lambda k: "blank" if k == "d" else "truncated" if k.isupper() else None
    rng = random.Random(1)
    kinds = ["".join(k) for n in range(5) for k in itertools.product(letters, repeat=n)] + ["".join(rng.choices(letters, k=rng.randint(5, 40))) for _ in range(300)]
    for k in kinds:
        assert audit(k) == cheapest([(x.lower(), fault(x)) for x in k])[1], k


def made(seed, conversations=40, long=0):
    rng = random.Random(seed)
    some = lambda: rng.choice(["Hi.", "Hm", "", " \t", "What? ", "é日本!", "So it goes\x0b", "a.b"])
    rows = []
    for c in range(conversations):
        n = long if c == 3 and long else rng.randint(0, 12)
        for t in range(n):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.8 else rng.choice(["system", "user", "assistant", "tool", "", "ux", None])
            rows.append((c, t + rng.choice([0, 0, 0, 2]) if rng.random() < 0.95 else None, role, some() + (f" {rng.randint(0, 500)}." if rng.random() < 0.7 else "")))
    return rows + rows[: len(rows) // 20]


@pytest.mark.parametrize(("seed", "long", "block"), [(1, 0, 16384), (2, 700, 7), (3, 300, 1), (4, 500, 64)])
def test_same_as_search(spark, seed, long, block):
    rows = [*made(seed, long=long), (None, 1, "user", "Nameless."), (None, 2, "user", "Nameless.")]
    rng = random.Random(seed)
    rng.shuffle(rows)
    got = audits(repaired(spark.createDataFrame(rows, TURNS).repartition(5), block_turns=block)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_repaired_turns(spark):
    long = "x" * 200_000 + "."
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 2, "user", long), (1, 5, "user", "cut off")]
    df = spark.createDataFrame([(*r, "m", 1, "e") for r in rows], TURNS + ", block string, at int, edit string")
    got = repaired(df, block_bytes=1000).orderBy("at", "step").collect()
    assert "".join(r.edit for r in got) == cheapest(faults_of([r[1:] for r in rows]))[1]
    assert [(r.role, r.text) for r in got if r.edit != "D"][0] == ("system", "Be kind.")
    assert [r.fault for r in got if r.edit != "I"] == [None, None, "duplicate", None, "truncated"]
    assert [(r.was, r.turn, r.text) for r in got if r.edit == "I"] == [(None, None, "")] * sum(r.edit == "I" for r in got)
    assert repaired(df.limit(0)).count() == 0
    assert audits(repaired(df.limit(0))).count() == 0
