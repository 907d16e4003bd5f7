import json
import random

from simquarry.llm import chat_tools as ct

M = "conv_id long, turn long, role string, text string, name string"
TOOLS = {"add": {"a": ("integer", True), "b": ("number", False)}, "say": {"what": ("string", True)}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def link(spark, rows, schemas=TOOLS):
    df = spark.createDataFrame([(*r, "x") for r in rows], M)
    return {(r.conv_id, r.call_id, r.turn): r for r in ct.link_calls(*ct.parse_messages(df), schemas).collect()}


def test_linking_order_and_validation(spark):
    rows = [
        (1, 1, "assistant", call(("c3", "say", {"what": {"$ref": "c1"}, "z": 1}), ("c1", "add", {"b": 1.5, "a": 2}))),
        (1, 2, "assistant", call(("c2", "add", {"a": {"$ref": "c3"}, "x": {"$ref": "c1"}}), ("c1", "say", {"what": "again"}))),
        (1, 3, "tool", result("c1", 'three "and" a half')), (1, 4, "tool", result("c1", "late")), (1, 5, "tool", result("nobody", "?")),
        (2, 1, "assistant", call(("a", "add", {"a": {"$ref": "b"}}), ("b", "add", {"a": {"$ref": "a"}}), ("c", "none", "text"))),
    ]
    got = link(spark, rows)
    one = got[1, "c1", 1]
    assert (one.place, one.depth, one.status, one.n_results, one.valid) == (0, 0, "answered", 2, True)
    assert one.record == '{"arguments":{"a":2,"b":1.5},"id":"c1","name":"add","result":"three \\"and\\" a half"}'
    assert got[1, "c3", 1].depth == 1 and got[1, "c2", 2].depth == 2 and got[1, "c2", 2].place == 2
    assert got[1, "c3", 1].problems == ["unexpected z", "what is not string"]
    assert got[1, "c2", 2].problems == ["a is not integer", "unexpected x"]
    assert got[1, "c1", 2].status == "duplicate"
    assert got[1, "nobody", 5].status == "orphan"
    assert got[2, "a", 1].status == got[2, "b", 1].status == "cyclic"
    assert got[2, "c", 1].place == 0 and got[2, "c", 1].status == "unanswered"
    for r in got.values():
        assert json.dumps(json.loads(r.record), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.record


def test_long_chain(spark):
    rows = [(1, i, "assistant", call((f"c{i}", "say", {"what": {"$ref": f"c{i - 1}"} if i else "x"}))) for i in range(70)]
    got = link(spark, rows)
    assert all(got[1, f"c{i}", i].depth == got[1, f"c{i}", i].place == i for i in range(70))


def test_plain_conversations(spark):
    rows = [(7, 0, "system", "be brief"), (7, 1, "user", 'say "é"\n'), (7, 2, "assistant", "é"), (7, 3, "user", ""), (7, 5, "assistant", "lost"), (None, 1, "user", None), (7, 1, "user", 'say "é"\n')]
    got = link(spark, rows, ct.REPLY)
    assert len(got) == 4
    assert got[7, "7-1", 1].record == '{"arguments":{"prompt":"say \\"é\\"\\n","turn":1},"id":"7-1","name":"reply","result":"é"}'
    assert got[7, "7-3", 3].status == "unanswered" and got[7, "7-3", 3].depth == 1 and got[7, "7-3", 3].valid
    assert got[7, "7-4", 5].status == "orphan" and got[None, "-1", 1].status == "unanswered"


def test_empty_table(spark):
    assert ct.link_calls(*ct.parse_messages(spark.createDataFrame([], M))).count() == 0


# ---------------------------------------------------------------- against plain versions

KINDS = {
    "book": {
        "title": ("string", True), "pages": ("integer", False), "price": ("number", False), "ready": ("boolean", False), "tags": ("array<string>", False), "sizes": ("array<number>", False), "any": ("array", False),
        "mode": (["fast", "slow", 3], False), "author": ({"name": ("string", True), "born": ({"year": ("integer", True)}, False)}, False), "gone": ("null", False), "free": ("object", False),
    }
}


def plain_type(value, kind):
    if isinstance(kind, list):
        return any(value == v and type(value) is type(v) for v in kind)
    if kind.startswith("array<"):
        return isinstance(value, list) and all(plain_type(v, kind[6:-1]) for v in value)
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}[kind])


def plain_problems(args, fields, lead=""):
    out = [f"unexpected {lead}{k}" for k in args if k not in fields]
    for field, (kind, required) in fields.items():
        name = lead + field
        if field not in args:
            out += [f"missing {name}"] * required
        elif isinstance(kind, dict):
            out += plain_problems(args[field], kind, name + ".") if isinstance(args[field], dict) else [f"{name} is not object"]
        elif not plain_type(args[field], kind):
            out.append(f"{name} is not " + (kind if isinstance(kind, str) else "one of " + ", ".join(json.dumps(v) for v in kind)))
    return sorted(out)


def test_validation_equals_the_plain_one(spark):
    rng = random.Random(8)
    values = ["x", "", "fast", 3, 4, -1, 2.5, True, None, [], ["a"], ["a", 1], [1, 2.5], [None], {}, {"name": "n"}, {"name": 1}, {"name": "n", "born": {"year": 1900}}, {"name": "n", "born": {"year": "x", "z": 1}}, {"born": 5}]
    args = [{k: rng.choice(values) for k in rng.sample([*KINDS["book"], "other"], rng.randrange(0, 8))} for _ in range(400)]
    rows = [(1, i, "assistant", call((f"c{i}", "book", a))) for i, a in enumerate(args)]
    got = link(spark, rows, KINDS)
    for i, a in enumerate(args):
        assert got[1, f"c{i}", i].problems == plain_problems(a, KINDS["book"]), a
        assert json.loads(got[1, f"c{i}", i].record)["arguments"] == a


def test_what_is_no_object(spark):
    texts = ["[1]", "3", "nonsense", "", '{"title":"a","title":"b"}', "null"]
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "book", "arguments": t}]})) for i, t in enumerate(texts)]
    got = link(spark, rows, KINDS)
    assert all(got[1, f"c{i}", i].problems == ["arguments are not a JSON object"] for i in range(len(texts)))
    assert json.loads(got[1, "c4", 4].record)["arguments"] == texts[4]


def plain_depths(refs):
    """Longest chains by definition; None on or after a cycle."""
    out, state = {}, {}

    def depth(v):
        if state.get(v) == 1:
            return None
        if v not in out:
            state[v] = 1
            below = [depth(p) for p in refs[v]]
            out[v] = None if any(d is None for d in below) else max((d + 1 for d in below), default=0)
            state[v] = 2
        return out[v]

    for v in refs:
        depth(v)
    # A call that a cycle was entered through may have been cut short: repeat until nothing changes.
    changed = True
    while changed:
        changed = False
        for v, ps in refs.items():
            if out[v] is not None and any(out[p] is None for p in ps):
                out[v], changed = None, True
    return out


def test_depths_equal_the_plain_ones(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for conv in range(30):
        n = rng.randrange(1, 25)
        names = [f"c{i}" for i in range(n)]
        refs = {}
        for i, v in enumerate(names):
            pool = names[:i] if conv % 3 else names
            refs[v] = sorted(set(rng.sample(pool, min(len(pool), rng.choice([0, 1, 1, 1, 2, 3])))))
            rows.append((conv, i, "assistant", call((v, "say", {f"a{k}": {"$ref": p} for k, p in enumerate(refs[v])}))))
        want |= {(conv, v): d for v, d in plain_depths(refs).items()}
    got = {(c, i): r.depth for (c, i, _), r in link(spark, rows).items()}
    assert got == want and None in want.values()


def test_one_call_with_two_references_adds_one_round(spark, monkeypatch):
    """A long chain elsewhere isn't walked call by call."""
    rows = [(1, i, "assistant", call((f"c{i}", "say", {"what": {"$ref": f"c{i - 1}"} if i else "x"}))) for i in range(300)]
    rows.append((2, 0, "assistant", call(("a", "say", {}), ("b", "say", {}), ("c", "say", {"x": {"$ref": "a"}, "y": {"$ref": "b"}}))))
    tables = []
    real = ct.Scratch.table
    monkeypatch.setattr(ct.Scratch, "table", lambda self, df, name: tables.append(name) or real(self, df, name))
    got = link(spark, rows)
    assert got[1, "c299", 299].depth == 299 and got[2, "c", 0].depth == 1 and len(tables) < 25


def test_very_long_texts(spark):
    long = "word \"é\" " * 200_000
    got = link(spark, [(1, 0, "user", long), (1, 1, "assistant", long)], ct.REPLY)
    assert json.loads(got[1, "1-0", 0].record) == {"arguments": {"prompt": long, "turn": 0}, "id": "1-0", "name": "reply", "result": long}
