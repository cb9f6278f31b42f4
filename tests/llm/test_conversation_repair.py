import hashlib
import heapq
import random
import zlib

import pytest

from frisk.llm import conversation_repair as cr

SPACE = " \t\n\x0b\f\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if v is None else v for v in (conv, turn, role, text)]
        k = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2], said[3]
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def _cheapest(letters, roles):
    """Dijkstra over (row, grammar state) by (cost, audit): a plain shortest path, no suffixes shared."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(letters) and state in ("", "a"):
            return cost, audit, out
        forced = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[forced]
        heapq.heappush(heap, (cost + 2, audit + "I", at, forced, (*out, (name, None))))
        if at < len(letters):
            fault = letters[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, forced, (*out, (name, at))))
                to = step.get((state, roles[at][:1]))
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, (*out, (roles[at], at))))


def _brute(rows):
    convs, out = {}, set()
    for r in rows:
        convs.setdefault(r[0], [])
    for r in _damaged(rows):
        convs[r[0]].append(r[1:])
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, kept = _cheapest(faults, [r for _, r, _ in mine])
        said = "\n".join(f"{role}:{'' if at is None else mine[at][2]}" for role, at in kept)
        out.add((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return out


def _random_rows(seed, convs=150):
    rng, rows = random.Random(seed), []
    texts = ["Hello.", "Hello.", "no end", "", "  \n", "a. ", "Why?", "x" * 50 + "!", None, "é", "Yes!\t", "\xa0"]
    for conv in range(convs):
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn, turn + 3, None, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("run", [1, 3, 1024])
def test_rows_equal_brute_force(spark, run):
    rows = _random_rows(run) + [(None, None, None, None), (None, 1, "user", "Hi."), (-5, 2, "user", "Hi."), (-5, 2, "user", "Hi."), (-5, 2, "user", "Hi."), (-5, 2, "user", "Ho.")]
    long = [(9999, k, ["user", "assistant", "assistant", "system"][k % 7 % 4], f"text {k % 40}" + ".?"[k % 2] * (k % 5 > 0)) for k in range(300)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + long], "conv_id long, turn long, role string, text string, copies int, digest string")
    got = cr.damaged_and_repaired(table, run).collect()
    assert len(got) == len({r[0] for r in rows + long})
    assert {tuple(r) for r in got} == _brute(rows + long)


def test_one_hot_conversation_of_equal_rows(spark):
    rows = [(1, k // 50, "user", "Same text.") for k in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in cr.damaged_and_repaired(table, 256).collect()} == _brute(rows)


def test_repaired_rows_follow_the_grammar(spark):
    table = spark.createDataFrame(_random_rows(11), "conv_id long, turn long, role string, text string")
    rows = cr.damage(table)
    sha = {r.conv_id: r.repaired_sha256 for r in cr.repair(rows).collect()}
    convs = {}
    for r in sorted(cr.repaired_rows(rows).collect(), key=lambda r: (r.conv_id, r.position)):
        convs.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(sha[c] == hashlib.sha256("\n".join(convs.get(c, [])).encode()).hexdigest() for c in sha)
    import re
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in v)) for v in convs.values())


def test_suffixes_are_shared():
    automaton = cr.Automaton(cr.END)
    rng = random.Random(1)
    signatures = sorted({"".join(rng.choice("suaUAD") for _ in range(6)) for _ in range(2000)}, key=lambda s: s[::-1])
    for s in signatures:
        automaton.root(s)
    suffixes = {s[k:] for s in signatures for k in range(len(s))}
    assert automaton.made == len(suffixes) < sum(map(len, signatures))


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.damaged_and_repaired(table).count() == 0
