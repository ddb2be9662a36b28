import hashlib
import itertools
import random
import re
import zlib

import pytest
from cases import rows as result

from auctionflow.llm import common
from auctionflow.llm import conversations as C

SHAPE = re.compile("(s?(ua)+)?")


def faults_of(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        words = text.strip(C.SPACE)
        out.append("blank" if not words else "duplicate" if (role, text) in rows[:i] else "truncated" if words[-1] not in ".!?" else "")
    return out


def brute_edits(rows):
    """(cost, audit, repaired rows) by trying every edit of every row and up to two inserts in each gap."""
    faults, n = faults_of(rows), len(rows)
    inserts = [list(itertools.product(("user", "assistant"), repeat=k)) for k in range(3)]
    gaps = [x for k in inserts for x in k]
    best = None
    choices = []
    for (role, text), fault in zip(rows, faults):
        more = 3 if fault == "truncated" else 0
        ways = [(4, "D", None)]
        if fault in ("", "truncated"):
            ways += [(more, "K", (role, text)), *((3 + more, "R", (r, text)) for r in ("user", "assistant"))]
        choices.append(ways)
    for edits in itertools.product(*choices):
        base = sum(e[0] for e in edits)
        if best and base > best[0]:
            continue
        for extra in itertools.product(gaps, repeat=n + 1):
            cost = base + 3 * sum(map(len, extra))
            if best and cost > best[0]:
                continue
            out, audit = [(r, "") for r in extra[0]], "I" * len(extra[0])
            for e, more in zip(edits, extra[1:]):
                out += [e[2]] if e[2] else []
                out += [(r, "") for r in more]
                audit += e[1] + "I" * len(more)
            if all(r for r, _ in out) and SHAPE.fullmatch("".join(r[0] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def by_paths(rows):
    """The same by best audits as strings, from the end on; for conversations of any length."""
    faults, best = faults_of(rows), {0: (0, "", []), 3: (0, "", [])}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    other = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def inserted(v):
        v = dict(v)
        for _ in range(4):
            for s, (t, role) in other.items():
                if t in v:
                    way = (v[t][0] + 3, "I" + v[t][1], [(role, ""), *v[t][2]])
                    v[s] = min(v.get(s, way), way, key=lambda w: w[:2])
        return v

    best = inserted(best)
    for (role, text), fault in reversed(list(zip(rows, faults))):
        now = {}
        for s, (t, name) in other.items():
            ways = [(best[s][0] + 4, "D" + best[s][1], best[s][2])]
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (s, role[:1]) in step:
                    k = best[step[s, role[:1]]]
                    ways.append((k[0] + more, "K" + k[1], [(role, text), *k[2]]))
                ways.append((best[t][0] + 3 + more, "R" + best[t][1], [(name, text), *best[t][2]]))
            now[s] = min(ways, key=lambda w: w[:2])
        best = inserted(now)
    return best[0]


def brute(conversations):
    """The query's rows."""
    named = lambda x: " " if x is None else x
    by = {}
    for conv, turn, role, text in conversations:
        kept = by.setdefault(conv, [])
        kind = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        role, text = named(role), named(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in by.items():
        digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
        rows = [r[1:] for r in kept]
        turns = [t for t, _, _ in kept if t is not None]
        faults, initials = faults_of(rows), [r[:1] for r, _ in rows]
        cost, audit, fixed = by_paths(rows)
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def drawn(seed, n):
    random.seed(seed)
    return [(random.choice(["user", "assistant", "system", "user", "assistant", "tool", " ", ""]), random.choice(["Yes.", "No!", "cut", " ", "", "More?\n", "x " + str(random.random()) + "."])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_cheapest_by_brute_force(seed):
    rows = drawn(seed, seed % 4)
    kinds = {"": C.SOUND, "blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.TRUNCATED}
    got = C.cheapest([r[:1] for r, _ in rows], bytes(kinds[f] for f in faults_of(rows)))
    assert got == brute_edits(rows)[:2] == by_paths(rows)[:2]
    assert by_paths(rows)[2] == brute_edits(rows)[2]
    long = drawn(seed, 60)
    assert C.cheapest([r[:1] for r, _ in long], bytes(kinds[f] for f in faults_of(long))) == by_paths(long)[:2]


def test_query_by_brute_force(spark, sf_dir):
    table = common.table(spark, sf_dir, "conversations")
    assert result(C.repaired_digests(table)) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_hostile_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hello."), (1, 0, "user", None), (1, None, "assistant", "Hm."), (1, 0, "user", None), (2, 0, "", ""), (3, 5, "tool", "No end"), (3, 5, "tool", "No end"), (3, 2, "system", "Be kind.  \n")]
    rows += [(4, i, ("assistant", "user")[i % 2], f"Turn {i}." + " x" * 3000) for i in range(300)]
    rows += [(5, i, "user", "The same.") for i in range(100)] + [(6 + i, 0, "assistant", "An odd one") for i in range(60)]
    schema = "conv_id long, turn long, role string, text string, place long, summary boolean, digest string, fault int"
    made = spark.createDataFrame([(*r, 1, True, "clash", 7) for r in rows], schema)
    assert result(C.repaired_digests(made)) == brute(rows)
    assert C.repaired_digests(made.limit(0)).collect() == []
    fixed = {}
    for r in sorted(C.repair(C.whole(made)).collect(), key=lambda r: (r["conv_id"] or 0, r["place"])):
        fixed.setdefault(r["conv_id"], []).append(r["role"][0])
    assert all(SHAPE.fullmatch("".join(x)) for x in fixed.values()) and 4 in fixed
