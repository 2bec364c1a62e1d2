"""Schema changes against a plain reading of their definition."""

import json
import random
from collections import Counter

from gleanery.operators import schema_drift as sd

SCHEMA = "series_id long, file_id long, exported_at timestamp, line_no int, payload string"


def kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def flat(o, parent=""):
    for k, v in o.items():
        p = f"{parent}.{k}" if parent else k
        if v is not None and p != "case_id":
            yield p, v
            if isinstance(v, dict):
                yield from flat(v, p)


def brute(rows):
    files = {}
    for s, f, at, line, text in rows:
        files.setdefault((s, at, f), {})
        try:
            o = json.loads(text)
        except (ValueError, TypeError):
            continue
        if isinstance(o, dict):
            files[s, at, f][line] = o
    out = set()
    order = sorted(files)
    for old, new in zip(order, order[1:], strict=False):
        if old[0] != new[0]:
            continue

        def read(key):
            kinds, values = {}, {}
            for o in files[key].values():
                for p, v in flat(o):
                    kinds.setdefault(p, Counter())[kind(v)] += 1
                    values.setdefault(p, {})[o.get("case_id")] = v
            return {p: max(sd.KINDS, key=lambda k, c=c: (c[k], -sd.KINDS.index(k))) for p, c in kinds.items()}, values

        (ka, va), (kb, vb) = read(old), read(new)
        changes = [(p, "type_changed", "") for p in ka if p in kb and ka[p] != kb[p]]
        options = []
        for a in set(ka) - set(kb):
            for b in set(kb) - set(ka):
                if a.rpartition(".")[0] == b.rpartition(".")[0] and ka[a] == kb[b]:
                    cases = set(va[a]) & set(vb[b])
                    same = sum(va[a][c] == vb[b][c] for c in cases)
                    if same >= 3 and same >= 0.8 * len(cases):
                        options.append((-same / len(cases), -same, a, b))
        done_a, done_b = {}, set()
        for *_, a, b in sorted(options):
            if a not in done_a and b not in done_b:
                done_a[a] = b
                done_b.add(b)
        changes += [(a, "renamed", done_a[a]) if a in done_a else (a, "removed", "") for a in set(ka) - set(kb)]
        changes += [(b, "added", "") for b in set(kb) - set(ka) - done_b]
        roots = {p for c in changes for p in (c[0], c[2]) if p}
        out |= {(new[2], *c[:1], c[1], c[2]) for c in changes if not any(c[0].startswith(r + ".") for r in roots)}
    return out


def make(seed):
    rng = random.Random(seed)
    rows, file_id = [], 0
    from datetime import datetime, timedelta

    for series in (1, 2, 3):
        names = ["query", "score", "flag", "detail"]
        cases = {c: {n: rng.choice([rng.random(), str(rng.random()), rng.randint(0, 9)]) if n != "detail" else {"a": rng.random(), "b": rng.random()} for n in names} for c in range(12)}
        label = {n: n for n in names}
        for k in range(6):
            file_id += 1
            step = rng.choice(["rename", "drop", "add", "none", "nest", "type"])
            target = rng.choice(names)
            if step == "rename":
                label[target] = f"{target}_{k}"
            lines = []
            for c, values in cases.items():
                o = {"case_id": c} | {label[n]: v for n, v in values.items()}
                if step == "drop":
                    o.pop(label[target])
                if step == "add":
                    o["extra"] = {"x": 1, "y": [1]}
                if step == "type":
                    o[label[target]] = [1] if c % 5 else None
                if step == "nest" and isinstance(o.get(label["detail"]), dict):
                    o[label["detail"]] = {"a": values["detail"]["a"], "bb": values["detail"]["b"]}
                lines.append(json.dumps(o))
            lines += ["", "{broken", "[1,2]", None]
            at = datetime(2024, 1, 1) + timedelta(days=k)
            batch = [(series, file_id, at, i, t) for i, t in enumerate(lines)]
            rows += batch + (batch if rng.random() < 0.3 else [])
    rng.shuffle(rows)
    return rows


def test_changes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = make(seed)
        got = {tuple(r) for r in sd.schema_changes(spark.createDataFrame(rows, SCHEMA)).select("file_id", "path", "change_kind", "new_path").collect()}
        assert got == brute(rows) and got


def test_empty_and_odd_lines(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sd.schema_changes(empty).count() == 0
    from datetime import datetime

    rows = [(1, 1, datetime(2024, 1, 1), 1, '{"case_id": 1, "a": 1, "A": "x", "series_id": 5, "s": "\\ud800", "n": null}'), (1, 2, datetime(2024, 1, 2), 1, None)]
    table = sd.unified_table(spark.createDataFrame(rows, SCHEMA))
    assert len(set(c.lower() for c in table.columns)) == len(table.columns)
    assert table.count() == 1


def test_lattice(spark):
    from datetime import datetime

    rows = [(1, f, datetime(2024, 1, f), 1, t) for f, t in ((1, '{"a": 1, "b": true, "c": 1}'), (2, '{"a": 2.5, "b": false, "c": "x"}'))]
    got = {r["path"]: r["data_type"] for r in sd.union_schema(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": "double", "b": "boolean", "c": "string"}


def test_clashing_keys_lines_and_big_integers(spark):
    from datetime import datetime
    from decimal import Decimal

    big, huge, odd = 10**20 - 1, 10**45, 2**60 + 1
    texts = (
        (1, '{"a.b": 1, "a": {"b": 2}, "big": %d, "huge": %d, "mix": %d}' % (big, huge, odd)),
        (1, '{"a": {"b": 3}, "big": 5, "huge": 5, "mix": 0.5}'),
        (2, '\n\t{"big": null, "mix": 1}'),
    )
    rows = [(1, 1, datetime(2024, 1, 1), n, t) for n, t in texts]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    types = {r["path"]: r["data_type"] for r in sd.union_schema(df).collect()}
    assert types == {"a.b": "long", "a": "string", "big": "decimal(38,0)", "huge": "string", "mix": "string"}
    out = sorted(sd.unified_table(df).collect(), key=lambda r: (r["line_no"], r["a__b"] or 0))
    assert [r["line_no"] for r in out] == [1, 1, 2]
    assert [r["a__b"] for r in out] == [1, 3, None]
    assert [r["big"] for r in out] == [Decimal(big), Decimal(5), None]
    assert [r["huge"] for r in out] == [str(huge), "5", None]
    assert [r["mix"] for r in out] == [str(odd), "0.5", "1"]


def test_change_log_is_ordered_and_typed(spark):
    df = spark.createDataFrame(make(1), SCHEMA)
    log = sd.change_log(df).collect()
    assert {(r["file_id"], r["path"], r["change_kind"], r["new_path"]) for r in log} == {tuple(r) for r in sd.schema_changes(df).collect()}
    by_series: dict = {}
    for r in sorted(log, key=lambda r: (r["series_id"], r["change_no"])):
        by_series.setdefault(r["series_id"], []).append((r["change_no"], r["file_no"], r["old_type"], r["change_kind"]))
    for rows in by_series.values():
        assert [n for n, *_ in rows] == list(range(1, len(rows) + 1)) and [f for _, f, *_ in rows] == sorted(f for _, f, *_ in rows)
        assert all((t is None) == (kind == "added") for _, _, t, kind in rows)
