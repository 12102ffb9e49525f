"""Log records over split files, against a line-by-line reader."""

import json
import random
import re

from pyspark.sql import functions as F

from veil.sources import results as S

HEADER, SCORES, ATTACK = "评估用户: {} (第1轮)", "  隐私: {}, 效用: {}, 成功: True", "  攻击者推理: {}"


def plain_records(lines):
    """(username, privacy, utility, guess of age) per record, one line after the other."""
    out, text, depth = [], None, 0
    for line in lines:
        if S.USER in line:
            name = re.search(r"评估用户:\s*(\w+)", line)
            out.append([name[1] if name else "unknown", 0.0, 0.8, None])
            text = None
        elif S.PRIVACY in line and S.UTILITY in line:
            for at, label in ((1, S.PRIVACY), (2, S.UTILITY)):
                n = re.search(label + r"\s*([0-9.]+)", line)
                if out and n:
                    out[-1][at] = float(n[1])
        else:
            if any(label in line for label in S.ATTACK_LABELS) and "{" in line:
                text, depth, line = [], 0, line[line.index("{") :]
            if text is None:
                continue
            for at, c in enumerate(line):
                depth += (c == "{") - (c == "}")
                if c == "}" and depth <= 0:
                    text.append(line[: at + 1])
                    try:
                        found = json.loads("\n".join(text))
                        if out and isinstance(found, dict):
                            out[-1][3] = (found.get("age") or {}).get("guess", [None])[0]
                    except ValueError:
                        pass
                    text = None
                    break
            else:
                text.append(line)
    return [tuple(r) for r in out]


def made_lines(rng, n):
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2:
            out.append(HEADER.format(rng.choice([f"u{i}", "", f"user_{i}"])))
        elif kind < 0.4:
            out.append(SCORES.format(rng.choice(["0.5", "1.0", ".7"]), rng.choice(["0.9", "0.25"])))
        elif kind < 0.7:
            body = json.dumps({"age": {"guess": [str(i)], "certainty": 3}, "sex": {"guess": ["m", "f"], "certainty": 1}}, indent=rng.choice([None, 1]))
            lines = ATTACK.format(body + rng.choice(["", " done", "} {", " {x}"])).split("\n")
            if rng.random() < 0.2:
                lines = lines[: rng.randint(0, len(lines) - 1)] or [ATTACK.format('{"age": ')]
            if rng.random() < 0.2:
                lines.insert(rng.randint(1, len(lines)), SCORES.format("0.1", "0.2"))
            out += lines
        else:
            out.append(rng.choice(["", "note", "{", "}", "}}", '{"a": 1}', "attack_result: none", "attack_result: {", "a { b } c"]))
    return out


def found(records):
    age = F.col("attack")["age"]["guess"][0]
    rows = records.select("file", "record", "username", "privacy", "utility", age.alias("age")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["record"])):
        out.setdefault(r["file"], []).append((r["username"], r["privacy"], r["utility"], r["age"]))
    return out


def test_records_equal_a_plain_reader_wherever_files_are_cut(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for f in range(25):
        lines = made_lines(rng, rng.choice([3, 40, 150]))
        block = 0
        for seq, line in enumerate(lines):
            block += rng.random() < rng.choice([0.02, 0.3, 0.9])
            rows.append((f"f{f:02}", block, seq, line))
        expected[f"f{f:02}"] = plain_records(lines)
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "file string, block int, seq long, value string")
    assert found(S.log_records(lines)) == {f: r for f, r in expected.items() if r}
    assert any(a for r in expected.values() for *_, a in r)


def test_files_larger_than_a_split(spark, tmp_path):
    rng = random.Random(9)
    long_text = json.dumps({"age": {"guess": ["long"], "certainty": 2}, **{f"k{i}": {"guess": ["x" * 50], "certainty": 1} for i in range(400)}}, indent=1)
    texts = {}
    for name in ("a.log", "b.log"):
        lines = made_lines(rng, 400) + [HEADER.format("long")] + ATTACK.format(long_text).split("\n") + [HEADER.format("next")] + made_lines(rng, 400)
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
        texts[name] = plain_records(lines)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2048")
    try:
        lines = S.read_log(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 20
        got = {f.rsplit("/", 1)[1]: r for f, r in found(S.log_records(lines)).items()}
    finally:
        spark.conf.set(key, before)
    assert got == texts and any(r[3] == "long" for r in got["a.log"])


def test_no_lines_and_no_headers(spark):
    none = spark.createDataFrame([], "file string, block int, seq long, value string")
    assert S.log_records(none).count() == 0
    loose = [("f", 0, 0, SCORES.format("1", "1")), ("f", 0, 1, None), ("f", 1, 2, ATTACK.format("{"))]
    assert S.log_records(spark.createDataFrame(loose, none.schema)).count() == 0


def test_a_log_of_one_file_is_not_one_task(spark):
    """No window runs over a whole file of lines: each is inside a split, or over one row per split."""
    lines = spark.createDataFrame([("f", i // 50, i, HEADER.format(i)) for i in range(500)], "file string, block int, seq long, value string")
    plan = S.log_records(lines)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if line.strip(" +-:").startswith("Window")]
    assert windows and all("block#" in w.rsplit("],", 1)[0] for w in windows)
    assert S.log_records(lines).count() == 500
