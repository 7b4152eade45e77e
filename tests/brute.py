"""What queries that SQL can't express must give, by plain Python over the same files."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from quillon.functions.text import SCRUB


def _supply(con) -> list[tuple]:
    return con.sql("SELECT 'p' || l_partkey, 's' || l_suppkey, count(*) FROM lineitem GROUP BY 1, 2").fetchall()


def _components(pairs) -> dict:
    """The least node of each node's component."""
    up: dict = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def component_sizes(con, got):
    want = Counter(_components((a, b) for a, b, _ in _supply(con)).values())
    assert {r.label: r.n for r in got} == dict(want)


def flows(con, got):
    edges = _supply(con)
    members = defaultdict(set)
    for a, b, n in edges:
        if n > 1:
            members[b].add(a)
    seeded = set().union(*members.values()) if members else set()
    groups = defaultdict(set)
    for node, label in _components((a, b) for a, b, _ in edges).items():
        groups[label].add(node)
    for label, nodes in groups.items():
        if len(nodes) >= 3 and nodes - seeded:
            members[label] |= nodes - seeded
    for node, n in Counter(b for _, b, _ in edges).items():
        if n >= 6:
            members["hub:" + node].add(node)
    inner = {f: sum(a in own and b in own for a, b, _ in edges) for f, own in members.items()}
    assert {(r.flow, r.files, r.edges) for r in got} == {(f, len(own), inner[f]) for f, own in members.items()}


def louvain(con, got):
    nodes = {x for a, b, _ in _supply(con) for x in (a, b)}
    assert sum(r.files for r in got) == len(nodes) and {r.community for r in got} <= nodes and len(got) < len(nodes) / 2


def pii_scrub(con, got):
    def clean(text):
        for pattern, put in SCRUB:
            text = re.sub(pattern, put.replace("$1", r"\1"), text, flags=re.ASCII)
        return text

    want = {k: clean(t) for k, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)


def _vectors(con):
    rows = con.sql("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([r[2] for r in rows], np.float64)
    norm = np.linalg.norm(x, axis=1)
    both = np.outer(norm, norm)
    return [r[0] for r in rows], [r[1] for r in rows], np.divide(x @ x.T, both, out=np.zeros_like(both), where=both > 0)


def insight_sequence(con, got):
    ids, labels, sims = _vectors(con)
    want, kept = {}, defaultdict(list)
    for i, label in enumerate(labels):
        near = max(((round(sims[i, j], 9), -ids[j]) for j in kept[label]), default=(0.0, 0))
        want[ids[i]] = -near[1] if near[0] > 0.3 else ids[i]
        if want[ids[i]] == ids[i]:
            kept[label].append(i)
    assert {r.id: r.same_as for r in got} == want and len(got) == len(want)


def mmr(con, got):
    ids, _, sims = _vectors(con)
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: r.place):
        mine[r.query_id].append(r.id)
    at = {v: k for k, v in enumerate(ids)}
    assert set(mine) == {v for v in ids if v % 20 == 0}
    for q, chosen in mine.items():
        scores = {j: 2 - round(1 - sims[at[q], j], 6) for j in range(len(ids))}
        open_ = sorted(scores, key=lambda j: (-scores[j], ids[j]))[:20]
        most, want = max(scores[j] for j in open_), []
        while open_ and len(want) < 5:
            worth = [round(0.7 * scores[j] / most - 0.3 * max([0.0, *(sims[j, t] for t in want)]), 9) for j in open_]
            want.append(open_.pop(worth.index(max(worth))))
        assert chosen == [ids[j] for j in want], q


def kmeans_clusters(con, got):
    ids, _, _ = _vectors(con)
    x = np.array([r[0] for r in con.sql("SELECT embedding FROM embeddings ORDER BY vec_id").fetchall()], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    own = {r.id: r.cluster for r in got}
    assert sorted(own) == ids and len(got) == len(ids)
    label = np.array([own[k] for k in ids])
    kinds = np.unique(label)
    centres = np.stack([x[label == k].mean(0) for k in kinds])
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    nearest = kinds[(x @ centres.T).argmax(1)]
    assert 1 < len(kinds) <= 8 and (nearest == label).mean() > 0.9


def knn_ivf(con, got):
    v = con.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in v]), np.array([e for _, e in v], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = set()
    for k in np.flatnonzero(ids % 20 == 0):
        want |= {(int(ids[k]), int(i)) for i in ids[np.lexsort((ids, np.round(1 - x @ x[k], 6)))[:10]]}
    assert len(want & {(r.query_id, r.id) for r in got}) >= 0.9 * len(want)


def _first_words(text):
    return [w for w in re.split("[^a-z]+", (text or "").lower()) if w]


def _label_score(folder, label):
    low, words = folder.lower(), [w for w in label.lower().split() if len(w) >= 3]
    leaf = low.split("/")[-1]
    return sum(3 if w in leaf else int(w in low) for w in words) + 10 * (leaf == "".join(words)) + 10 * (leaf == "".join(label.lower().split()))


def label_matching(con, got):
    labels, folders = {}, {}
    for k, text in con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        if w := _first_words(text):
            if k % 2 == 0:
                labels.setdefault(" ".join(x.capitalize() for x in w[: 3 if k % 3 == 0 else 2]), k)
            else:
                folders.setdefault(f"src/{w[-1]}/" + ("" if k % 3 == 0 else "-").join(w[:2]), k)
    pairs = sorted((-s, a, b, x, y) for x, a in labels.items() for y, b in folders.items() if (s := _label_score(y, x)) >= 3)
    used, want = set(), set()
    for s, _, _, x, y in pairs:  # the best first, each label and each folder once
        if ("label", x) not in used and ("folder", y) not in used:
            used |= {("label", x), ("folder", y)}
            want.add((x, y, -s))
    assert {(r.label, r.folder, r.score) for r in got} == want and len(got) == len(want) > 20


def community_qualifiers(con, got):
    used, want = set(), {}
    for k, text in con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        w = _first_words(text)
        base = (w[0] if w else "main")[:2] + ("_2" if k % 11 == 0 else f"_{w[1] if len(w) > 1 else 'x'}" if k % 13 == 0 else "")
        path = "/".join(["app", *w[1:2], (w[2] if len(w) > 2 else "a") + ".rb"])
        tries = [base] + [f"{base}_" + re.sub(r"\.[^.]+$", "", x).replace("-", "_").lower() for x in path.split("/") if len(x) > 2 and x != base and not x.isdigit()]
        n = 2
        while not (free := [t for t in tries if t not in used]):
            tries, n = [f"{base}_{n}"], n + 1
        want[k] = free[0]
        used.add(free[0])
    assert {r.id: r.name for r in got} == want and sum(n.rsplit("_", 1)[-1].isdigit() for n in want.values()) > 10


def _ruby(lines):
    """Members of classes by a stack of scopes, a line at a time."""
    from quillon.sources.ruby import CALLBACKS

    stack = []  # [owner or None, visibility]
    for no, line in enumerate(lines):
        code = re.sub(r"(^|\s)#(\s.*)?$", "", line).strip()
        if not code:
            continue
        if re.match(r"end\b", code):
            if stack:
                stack.pop()
            continue
        owner = stack[-1][0] if stack else None
        word = re.match(r"\w*", code)[0]
        if stack and code in ("private", "protected", "public"):
            stack[-1][1] = code
        if m := re.match(r"def (self\.)?(\w+[?!=]?|[^\s\w(]+)", code):
            if owner:
                yield no, owner, "method", (m[1] or "") + m[2], stack[-1][1], None
            elif not stack and not m[1]:
                yield no, None, "method", m[2], "public", None
        elif owner and (m := re.match(r"(has_many|belongs_to|has_one)[ (]:(\w+?)\)?(?:, (.*))?$", code)):
            target = re.search(r"class_name: '(\w+)'", code)
            one = {"companies": "company"}.get(m[2], m[2])
            name = target[1] if target else "".join(w[:1].upper() + w[1:] for w in one.split("_"))
            yield no, owner, "association", m[2], None, " ".join(x for x in (m[1], name, m[3]) if x)
        elif owner and word in ("validates", "validate"):
            yield no, owner, "validation", word, None, ", ".join(x[1:] for x in re.sub(r"\[.*?\]", "", code[len(word) :]).replace(",", " ").split() if x[0] == ":" and x != ":on?")
        elif owner and word in CALLBACKS:
            yield no, owner, "callback", word, None, None
        elif owner and (m := re.match(r"scope :(\w+)", code)):
            yield no, owner, "method", f"scope:{m[1]}", "public", None
        opens = re.match(r"(class|module|def|if|private def)\b", code) or code.endswith("|x|") or "= case" in code
        if opens and not code.endswith("; end") and not re.match(r"def \w+ = ", code):
            named = re.match(r"class ([A-Z]\w*)", code)
            stack.append([named and named[1], "public"])


def ruby_members(con, got):
    from quillon.sources.ruby import TEMPLATES

    want = []
    for doc, text in con.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        lines = [TEMPLATES[len(x) % len(TEMPLATES)].replace("{{", "<").replace("}}", ">").replace("{}", str(len(x))) for x in text.split("\n")]
        lines[0] = "class Top < Base"
        want += [(doc, *m) for m in _ruby(lines)]
    key = lambda rows: sorted(rows, key=str)
    assert key((r.file, r.no, r.owner, r.kind, r["name"], r.visibility, r.detail) for r in got) == key(want)
    assert {m[5] for m in want} >= {"private", "protected", "public"} and len({m[3] for m in want}) == 4


def _script_statements(con):
    """Statements of the documents' code by a walk over characters."""
    from quillon.sources.scripts import TEMPLATES

    for doc, text in con.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        depth, held, first = 0, [], 0
        for no, x in enumerate(text.split("\n")):
            line = TEMPLATES[len(x) % len(TEMPLATES)].replace("{}", str(len(x)))
            if line.startswith("//"):
                continue
            if depth == 0 and held:
                yield doc, first, "\n".join(held).strip()
                held = []
            if not held:
                first = no
            held.append(line)
            quote, net = None, 0
            for ch in line:
                if quote:
                    quote = None if ch == quote else quote
                elif ch in "'\"`":
                    quote = ch
                else:
                    net += (ch in "{([") - (ch in "})]")
            depth = max(0, depth + net)
        if held:
            yield doc, first, "\n".join(held).strip()


def script_statements(con, got):
    want = sorted(_script_statements(con))
    assert sorted((r.file, r.no, r.text) for r in got) == want and any(x.count("\n") > 3 for _, _, x in want)


def script_parts(con, got):
    want, seen = Counter(), set()
    for doc, no, text in _script_statements(con):
        add = lambda kind, name, detail=None: want.update([(doc, no, kind, name, detail)])  # noqa: B023, E731
        if m := re.match(r"export (default )?(function|class) (\w+)", text):
            add("export", m[3], "default" if m[1] else None)
        if m := re.match(r"export const (\w+) = ", text):
            add("export", m[1])
        if m := re.match(r"export \{ a, b as c\d+ \}", text):
            add("export", "a")
            add("export", "b")
        if m := re.match(r"(?:export )?function (\w+)", text):
            add("function", m[1])
        if m := re.match(r"const (\w+) = async \(x\) =>", text):
            add("function", m[1], "async")
        for m in re.finditer(r"(?:router|app|\))\s*\.(get|post|use)\(\s*(?:['\"]([^'\"]*)['\"])?", text):
            path = m[2] or ("/*" if m[1] == "use" else None)
            if path and (doc, m[1], path) not in seen:
                seen.add((doc, m[1], path))
                add("route", path, m[1].upper())
            if m[1] != "use":
                add("call", m[2], m[1].upper())
        for m in re.finditer(r"fetch\(`([^`]*)`", text):
            add("call", m[1], "FETCH")
        for _ in re.finditer(r"api\.destroy\(path\)", text):
            add("call", None, "DELETE")
        for m in re.finditer(r"(use\w+Store)\(", text):
            add("uses", m[1])
        if m := re.search(r"defineStore\('(\w+)'", text):
            add("store", m[1])
    assert {(r.file, r.no, r.kind, r["name"], r.detail): r.n for r in got} == dict(want)
    assert {k[2] for k in want} == {"export", "function", "route", "call", "uses", "store"}
