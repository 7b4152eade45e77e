"""Transcript parsers against a plain version, line by line."""

import json

from quillon.sources import transcripts

FLAT = ['{"role": "Human", "content": "hi"}', "", "no json", '{"type": "message", "content": ["x", {"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}', '{"type": "message", "role": "tool", "content": "out"}',
        '{"role": "", "content": "dropped"}', '{"type": "message", "role": "", "content": "kept"}', '{"role": "user", "content": ""}', '{"role": 5, "content": "number"}', "null", "5", '{"role": "user", "content": "[1, 2]"}', '{"role": "user", "content": {"a": 1}}']
NESTED = ["  ", '{"type": "say", "message": {"role": "human", "content": [{"type": "text", "text": " padded "}], "ts": "t1"}}', '{"type": "say", "message": {"content": "no role"}}', '{"role": "function", "content": "f", "timestamp": "t2"}', '{"type": "say"}', '{"type": "message", "content": "no role in this dialect"}']
FIRST_BY_MESSAGE = ['{"message": {}}', '{"type": "say", "message": {"role": "user", "content": "é\\n日"}}']


def text_of(content):
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return " ".join((c.get("text") or "") if c.get("type") == "text" else "" for c in content if isinstance(c, dict)).strip()
    return ""


def plain(name, lines):
    def load(x):
        try:
            return json.loads(x.strip())
        except ValueError:
            return None

    first = load(next((x for x in lines if x.strip()), ""))
    nested = not name.endswith(".jsonl") or isinstance(first, dict) and (first.get("type") == "say" or isinstance(first.get("message"), (dict, list)))
    out = []
    for no, x in enumerate(lines):
        v = load(x)
        if not isinstance(v, dict):
            continue
        said = nested and v.get("type") == "say" and isinstance(v.get("message"), dict)
        m = v["message"] if said else v
        role, free = m.get("role"), said or (not nested and v.get("type") == "message")
        if not (role if role is not None and not free else free) or (role is not None and not isinstance(role, str)):
            continue
        low = (role if role is not None else "assistant").lower()
        if text := text_of(m.get("content")):
            out.append((name, no, "user" if low in ("user", "human") else "tool" if low in ("tool", "function") else "assistant", text, (m.get("ts") if said else m.get("timestamp")) if nested else None))
    return out


def test_dialects(spark, tmp_path):
    files = {"a.jsonl": FLAT, "b.jsonl": NESTED, "c.jsonl": FIRST_BY_MESSAGE, "d": NESTED[2:], "e.jsonl": [""], "f.jsonl": NESTED[::-1]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines))
    got = transcripts.json_turns(transcripts.read_lines(spark, f"file://{tmp_path}"))
    assert sorted((r.file.rsplit("/", 1)[1], r.no, r.role, r.text, r.ts) for r in got.collect()) == sorted(x for name, lines in files.items() for x in plain(name, lines))
    shown = {(r.file.rsplit("/", 1)[1], r.part): r.text for r in transcripts.conversation_text(got, 3).collect()}
    assert shown["a.jsonl", 0].split("\n")[:2] == ["USER: hi", "ASSISTANT: a  "] and "TOOL" not in "".join(shown.values())


def test_headings(spark):
    text = "before\n## User: one\ntwo\n> ai: three\n### Human:\n\n# Notes: four\n>user:five\n> cursor: no heading\n## Claude:   "
    row = spark.createDataFrame([(text,), ("",)], "t string").select(transcripts.heading_turns(transcripts.F.col("t")).alias("x")).collect()
    assert [tuple(t) for t in row[0].x] == [("assistant", "before"), ("user", "one\ntwo"), ("assistant", "three"), ("user", "# Notes: four"), ("user", "five\n> cursor: no heading")] and row[1].x == []
