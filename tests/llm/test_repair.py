import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillspark.llm import repair
from quillspark.llm.queries import op11_repair

RIGHT = re.compile(r"(s?(ua)+)?")
BLANK, END = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
COLUMNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        part = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    """Rows of one conversation in order: 'blank', 'duplicate', 'truncated' or ''."""
    seen, out = set(), []
    for _, _, role, text in rows:
        out.append("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "" if END.search(text) else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by relaxing over every prefix of rows and every last letter, until nothing improves."""
    marks = faults(rows)
    best = {(0, ""): (0, "", ())}

    def offer(key, weight):
        if key not in best or weight[:2] < best[key][:2]:
            best[key] = weight
            return True
        return False

    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    for i in range(len(rows) + 1):
        changed = True
        while changed:
            changed = False
            for last in ("", "s", "u", "a"):
                if (i, last) in best:
                    cost, audit, out = best[i, last]
                    for role in ("user", "assistant"):
                        if role[0] in follows[last]:
                            changed |= offer((i, role[0]), (cost + 3, audit + "I", (*out, f"{role}:")))
        if i == len(rows):
            break
        _, _, role, text = rows[i]
        extra = 3 * (marks[i] == "truncated")
        for last in ("", "s", "u", "a"):
            if (i, last) not in best:
                continue
            cost, audit, out = best[i, last]
            offer((i + 1, last), (cost + 4, audit + "D", out))
            if marks[i] in ("blank", "duplicate"):
                continue
            if role[:1] and role[:1] in follows[last]:
                offer((i + 1, role[0]), (cost + extra, audit + "K", (*out, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if new[0] in follows[last]:
                    offer((i + 1, new[0]), (cost + 3 + extra, audit + "R", (*out, f"{new}:{text}")))
    cost, audit, out = min(best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best)
    return cost, audit, "\n".join(out)


def expected(rows, hurt=damage):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2][:16].encode(), r[3][:16].encode(), r[2].encode(), r[3].encode())
    after = {}
    for r in hurt(rows):
        after.setdefault(r[0], []).append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(after.get(conv, []), key=order)
        turns = {r[1] for r in own} - {None}
        marks = faults(own)
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, text = cheapest(own)
        out.append((str(conv), max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(text)))
    return sorted(out)


def result(df):
    return sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect())


def whole(rows):
    """Rows as they are, with null roles and texts as spaces."""
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


def test_whole_table_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = result(op11_repair(spark, sf))
    assert got == expected(rows)
    assert any(r[6] for r in got)


def test_audits_are_least_of_all_edit_sequences():
    """Every sequence of edits with at most two insertions in a gap, judged by the pattern alone."""
    rng = random.Random(4)
    gaps = [("", "")] + [("I" * n, p) for n in (1, 2) for p in map("".join, itertools.product("ua", repeat=n))]
    for _ in range(25):
        rows = [(1, i, rng.choice(["user", "assistant", "system", "user"]), rng.choice(["", "a.", "b", f"c{i}!"])) for i in range(rng.randint(0, 3))]
        marks, best = faults(rows), None
        choices = [[("D", "", 4)] + ([] if m in ("blank", "duplicate") else [(e, r, c + 3 * (m == "truncated")) for e, r, c in (("K", row[2][0], 0), ("R", "u", 3), ("R", "a", 3))]) for row, m in zip(rows, marks, strict=True)]
        for edits in itertools.product(*choices):
            for inserted in itertools.product(gaps, repeat=len(rows) + 1):
                letters = inserted[0][1] + "".join(e[1] + g[1] for e, g in zip(edits, inserted[1:], strict=True))
                if RIGHT.fullmatch(letters):
                    weight = (3 * sum(len(g[0]) for g in inserted) + sum(e[2] for e in edits), inserted[0][0] + "".join(e[0] + g[0] for e, g in zip(edits, inserted[1:], strict=True)))
                    best = weight if best is None or weight < best else best
        own = repair.Stretch()
        for row, m in zip(rows, marks, strict=True):
            own.row(row[1], row[2][0], 1, m == "blank", m == "duplicate", m == "truncated")
        assert repair.goal_of(own.span(closed=True)) == best == cheapest(rows)[:2]


@pytest.mark.parametrize("size", [2, 7])
def test_stretches_join_to_the_same(size, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH", size)
    rng = random.Random(size)
    for _ in range(60):
        rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system", "tool", ""]), rng.choice(["x.", "x", "", f"y{i}.", f"z{i}"])) for i in range(rng.randint(0, 30))]
        own = repair.Stretch()
        for row, m in zip(rows, faults(rows), strict=True):
            own.row(row[1], row[2][:1], 1, m == "blank", m == "duplicate", m == "truncated")
        assert repair.goal_of(own.span(closed=False)) == cheapest(rows)[:2]


def test_long_conversations_over_many_tasks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(c, i, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"u{i}.", f"u{i}", " "])) for c, n in ((1, 900), (2, 3), (3, 1), (4, 700), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    assert result(repair.report(df)) == expected(rows, whole)
    assert result(repair.report(repair.damaged(df), copies_col="copies")) == expected(rows)


def test_nulls_ties_repeats_and_odd_roles(spark):
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 2, "user", "a."), (1, 2, "user", "a."), (1, 2, "assistant", "b"), (1, 9, "Assistant", "c."), (2, None, None, None), (3, 5, "", "x."), (3, 5, "tool", "\t\n"), (4, 1, "system", "s."), (5, 0, "user", "é?\x0b "), (5, 3, "assistant", "w" * 300_000 + ".")]
    rows += [(7, 1, "user", "again.")] * 50 + [(7, i, "user", "again.") for i in range(2, 30)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], COLUMNS + ", cost int, _conv string")
    assert result(repair.report(df)) == expected(rows, whole)
    assert result(repair.report(repair.damaged(df), copies_col="copies")) == expected(rows)
    assert repair.report(df.limit(0)).count() == 0


def test_conversations_without_rows_after_damage(spark):
    gone = [(c, t, "user", "x.") for c in range(300) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = result(repair.report(repair.damaged(spark.createDataFrame(gone, COLUMNS)), copies_col="copies"))
    assert got and got == sorted((str(c), 0, 0, 0, 0, 0, 0, "", sha("")) for c, *_ in gone)


def test_repaired_rows_alternate(spark, sf):
    own = repair.with_faults(repair.damaged(spark.read.parquet(f"{sf}/conversations.parquet")), copies_col="copies")
    rows = repair.repaired(own, repair.plans(repair.stretches(own))).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r._conv, r.place)):
        by[r._conv] = by.get(r._conv, "") + r.role[0]
    assert by and all(RIGHT.fullmatch(x) for x in by.values())
