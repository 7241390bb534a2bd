import time

from siftwell.llm import linedup


def brute(rows, least=3):
    """Kept text and number of removed lines per row, in input order of (id, text)."""
    seen, out = set(), []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        lines = t.split("\n")
        full = [n for n, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for s in range(len(full) - least + 1):
            run = tuple(lines[n] for n in full[s : s + least])
            if run in seen:
                gone.update(full[s : s + least])
            seen.add(run)
        out.append((i, "\n".join(x for n, x in enumerate(lines) if n not in gone), len(gone)))
    return out


def test_matches_brute_force(spark, docs, rng):
    pool = [f"line {i}" for i in range(9)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))), "s") for i in range(80)]
    rows += [(100, "x\nx\nx\nx\nx", "s"), (101, None, "s"), (102, "", "s")]
    got = {r["_row"]["doc_id"]: (r["kept"], r["removed"]) for r in linedup.dedup(docs(rows)).collect()}
    assert got == {i: (t, n) for i, t, n in brute(rows)}


def test_odd_rows(spark, docs, odd_rows):
    got = linedup.dedup(docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert sum(r["removed"] > 0 for r in got) == 1  # the second long text
    assert {r["_row"]["_k"] for r in got} == {"clash"}
    stage = linedup.dedup_stage(docs(odd_rows))
    assert stage.columns == docs([]).columns
    assert stage.count() == len(odd_rows) - 1


def test_empty_table(spark, docs):
    assert linedup.dedup(docs([])).collect() == []


def test_short_runs_of_many_words(spark, docs, rng):
    pool = [f"line {i} " + "w " * (12 * i) for i in range(7)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8))), "s") for i in range(60)] + [(100, pool[6], "s"), (101, "line 0 ", "s"), (102, None, "s")]
    got = {r["_row"]["doc_id"]: (r["kept"], r["removed"]) for r in linedup.dedup(docs(rows), min_lines=4, min_words=50).collect()}
    assert got == {i: (t, n) for i, t, n in brute_by_words(rows, 4, 50)}


def brute_by_words(rows, least, words):
    seen, out = set(), []
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        full = [n for n, x in enumerate(lines) if x.strip()]
        gone = set()
        for s in range(len(full)):
            for k in range(1, least + 1):
                run = tuple(lines[n] for n in full[s : s + k])
                if len(run) == k and (k == least or len(" ".join(run).split()) >= words):
                    if run in seen:
                        gone.update(full[s : s + k])
                    seen.add(run)
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone), len(gone)))
    return out


def test_stage_drops_a_long_line_said_before(spark, docs, rng):
    line = " ".join(f"w{i}" for i in range(60))
    kept = linedup.dedup_stage(docs([(1, "one\n" + line, "s"), (2, "two\n" + line, "s"), (3, line, "s"), (4, "one", "s")])).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: "one\n" + line, 2: "two", 4: "one"}


def test_long_text_takes_time_in_proportion_to_its_lines(spark, docs):
    took = []
    for n in (4000, 32000):
        text = "\n".join(f"line {i}" for i in range(n))
        rows = [(1, "a\nb\nc", "s"), (2, text + "\na\nb\nc", "s")]
        began = time.perf_counter()
        got = {r["_row"]["doc_id"]: (r["kept"], r["removed"]) for r in linedup.dedup(docs(rows)).collect()}
        took.append(time.perf_counter() - began)
        assert got == {1: ("a\nb\nc", 0), 2: (text, 3)}
    assert took[1] < 4 * took[0] + 4
