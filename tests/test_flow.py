"""Taint over structure: golden files in five languages, and random programs against an interpreter of what they were written from."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codesift.operators import flow

GOLDEN = {
    "javascript": (
        """const { exec } = require('child_process');
function handle(req, res) {
  const untrusted =
    req.query
      .cmd;
  let a = untrusted;
  var b = a, c = b;
  exec(
    "ls " +
      c,
    (err, out) => { res.send(out); });
  const { id, name: alias } = req.body;
  if (id) { let a = 1; eval(a); }
  eval(a);
  db.query(`SELECT ${
    alias}`, [id]);
  el.innerHTML = id;
  const safe = parseInt(id);
  db.query("x" + safe);
  const other = wrap(id);
  eval(other);
  app.get('/x', (id) => {
    eval(id);
    const z = req.params.z;
    db.query('a' + z);
  });
  eval(z);
}
""",
        [("req.query", 4, "exec(", 8, 4, 1), ("req.query", 4, "eval(", 14, 2, 1), ("req.body", 12, "query(", 15, 1, 1), ("req.body", 12, "query(", 15, 1, 2), ("req.body", 12, "innerHTML", 17, 1, 0), ("req.params", 24, "query(", 25, 1, 1)],
    ),
    "python": (
        '''def f(request):
    """os.system(request.args)"""
    q = request.args.get(
        "q")
    if x:
        q = clean
    cur = "a" \\
        + q
    cursor.execute(
        f"select {cur}",
    )
    def g(q):
        os.system(q)
    for w in q:
        os.system(w)
    n = int(q)
    cursor.execute("x %s" % n)
    q = "ok"
    eval(q)
eval(q)
''',
        [("request.args", 3, "cursor.execute(", 9, 2, 1), ("request.args", 3, "os.system(", 15, 2, 1)],
    ),
    "java": (
        """class A {
  @GetMapping("/x")
  String show(@RequestParam String name, String other) {
    String q = "SELECT "
        + name;
    Statement.executeQuery(q); stmt.execute(other);
    String id = request.getParameter("id");
    /* Statement.execute(id); */
    int n = Integer.parseInt(id);
    Statement.execute("x" + n);
    if (ok) { id = "y"; }
    new File(base,
        id);
    id = "z";
    new File(id);
  }
  void next() { new File(id); }
}
""",
        [("@RequestParam", 3, "Statement.executeQuery(", 6, 1, 1), ("request.getParameter", 7, "new File(", 12, 1, 2)],
    ),
    "go": (
        """package main
func h(w http.ResponseWriter, r *http.Request) {
	name := r.FormValue("name")
	if x := name; x != "" {
		db.Query("a " + x)
	}
	db.Query("b" + x)
	opts := Options{Name: r.URL.Query().Get("q"),
		Other: 1}
	exec.Command("sh",
		opts.Name)
	n, err := strconv.Atoi(name)
	db.Exec("c" + n)
	func() {
		name := "clean"
		db.Query(name)
	}()
	db.Query(name)
}
""",
        [("r.FormValue", 3, "db.Query(", 5, 2, 1), ("r.URL.Query", 8, "exec.Command(", 10, 1, 2), ("r.FormValue", 3, "db.Query(", 18, 1, 1)],
    ),
    "php": (
        """<?php
$id = $_GET['id'];
$q = "SELECT * FROM t
  WHERE id = $id";
mysql_query($q,
  $link);
function show($id) {
  eval($id);
  echo htmlspecialchars($_POST['x']);
  echo $_POST['y'];
}
foreach ($_COOKIE as $c) {
  system($c);
}
$id = intval($id);
mysql_query("a" . $id);
""",
        [("$_GET", 2, "mysql_query(", 5, 2, 1), ("$_POST", 10, "echo ", 10, 0, 0), ("$_COOKIE", 12, "system(", 13, 1, 1)],
    ),
}


@pytest.mark.parametrize("language", GOLDEN)
def test_golden(language):
    text, want = GOLDEN[language]
    assert [(s, sl, k, kl, steps, arg) for s, sl, k, _, kl, steps, arg in flow.structural_flows(language, text)] == want


def test_through_calls():
    text = "x = wrap(req.body.a); y = wrap(x); eval(y); eval(x.trim());"
    assert [f[4:] for f in flow.structural_flows("javascript", text)] == []
    assert {(f[0], f[5]) for f in flow.structural_flows("javascript", text, True)} == {("req.body", 1), ("req.body", 2)}


# ---- random programs: what they mean is known before they are written down

STYLE = {
    # source, call that harms, unknown call, cleanser (of its kind), variable, statement end
    "javascript": ("req.body", "eval", "wrap", "", ";"),
    "python": ("sys.argv", "eval", "wrap", "", ""),
    "java": ("request.getHeader", "Runtime.exec", "wrap", "", ";"),
    "go": ("os.Args", "exec.Command", "wrap", "", ""),
    "php": ("$_GET", "system", "wrap", "$", ";"),
}
SCOPED = ("javascript", "java", "go")


def program(rng, language, depth=0):
    out = []
    for _ in range(rng.randrange(2, 7)):
        atoms = [rng.choice(["var", "var", "var", "source", "text", "call"]) for _ in range(rng.randrange(1, 4))]
        expr = [(a, rng.choice("abcd")) for a in atoms]
        kind = rng.choice(["assign", "assign", "declare", "sink", "branch", "function"] if depth < 3 else ["assign", "declare", "sink"])
        if kind in ("branch", "function"):
            out.append((kind, rng.choice("abcd"), program(rng, language, depth + 1)))
        else:
            out.append((kind, rng.choice("abcd"), expr))
    return out


def write(rng, language, body, lines, marks, depth=0):
    """Adds the program's lines; ``marks`` gets the line of each source and each harmful call, in order."""
    source, sink, unknown, sign, end = STYLE[language]
    pad = ("    " if language == "python" else "  ") * depth

    def put(pieces):
        """Pieces joined with line feeds where the language allows them; the lines of marked pieces are noted."""
        text = pad
        line = len(lines) + 1
        inside = 0
        for k, (piece, mark) in enumerate(pieces):
            if mark is not None:
                marks[mark] = line + text.count("\n")
            text += piece
            inside += piece.count("(") - piece.count(")")
            last = k + 1 == len(pieces)
            free = inside > 0 or piece.endswith((" + ", " . ")) and language != "python" or language in ("java", "php") and not last and piece.endswith("= ")
            if free and not last and rng.random() < 0.4:
                text += "\n" + pad + "      "
        lines.extend(text.split("\n"))

    def expr(e, at):
        out = []
        for k, (kind, name) in enumerate(e):
            plus = (" . " if language == "php" else " + ") if k + 1 < len(e) else ""
            text = {"var": f"{sign}{name}", "source": source, "text": "'a{b; c'" if language in ("javascript", "python", "php") else '"a{b; c"', "call": f"{unknown}({sign}{name})"}[kind]
            out.append((text + plus, (*at, k) if kind == "source" else None))
        return out

    for i, s in enumerate(body):
        kind, name, rest = s
        at = (*marks["path"], i)
        if kind in ("branch", "function"):
            if kind == "branch":
                lines.append(pad + {"python": f"if {name}:", "go": f"if {name} {{"}.get(language, f"if ({sign}{name}) {{"))
            else:
                lines.append(pad + {"python": f"def f({name}):", "javascript": f"on('x', ({name}) => {{", "go": f"func f({name} string) {{", "java": f"void f(String {name}) {{", "php": f"function f({sign}{name}) {{"}[language])
            marks["path"] = at
            write(rng, language, rest, lines, marks, depth + 1)
            marks["path"] = at[:-1]
            if language != "python":
                lines.append(pad + ("});" if kind == "function" and language == "javascript" else "}"))
        elif kind == "sink":
            put([(f"{sink}(", at), *expr(rest, at), (f"){end}", None)])
        else:
            left = f"{sign}{name}"
            declare = kind == "declare"
            op = {"javascript": f"let {left} = ", "java": f"String {left} = ", "go": f"{left} := "}.get(language, f"{left} = ") if declare else f"{left} = "
            put([(op, None), *expr(rest, at), (end, None)])


def meaning(language, body, marks):
    """The flows by an interpreter of the program itself."""
    source, sink, *_ = STYLE[language]
    flows = set()

    def run(body, path, scopes):
        # scopes: inner to outer, each (names, is a function)
        def lookup(name):
            return next((names[name] for names, _ in scopes if name in names), [])

        def carried(e, at):
            out = []
            for k, (kind, name) in enumerate(e):
                if kind == "var":
                    out += lookup(name)
                elif kind == "source":
                    out.append((marks[(*at, k)], 0))
            return out

        for i, (kind, name, rest) in enumerate(body):
            at = (*path, i)
            if kind == "branch":
                run(rest, at, [({}, False), *scopes])
            elif kind == "function":
                run(rest, at, [({name: []}, True), *scopes])
            elif kind == "sink":
                flows.update((source, line, marks[at], steps) for line, steps in carried(rest, at))
            else:
                best = {}
                for line, steps in carried(rest, at):
                    best[line] = min(best.get(line, 99), steps + 1)
                value = [*best.items()]
                function = next(k for k, (_, f) in enumerate(scopes) if f)
                if language in SCOPED:
                    owner = 0 if kind == "declare" else next((k for k, (names, _) in enumerate(scopes) if name in names), function)
                else:
                    owner = function
                keep = scopes[owner][0].get(name, []) if owner else []
                scopes[owner][0][name] = list(dict.fromkeys([*keep, *value]))

    run(body, (), [({}, True)])
    return flows


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(sorted(STYLE)), st.integers(0, 10**9))
def test_random_programs(language, seed):
    rng = random.Random(seed)
    body, lines, marks = program(rng, language), [], {"path": ()}
    write(rng, language, body, lines, marks)
    text = "\n".join(lines)
    found = {(f[0], f[1], f[4], f[5]) for f in flow.structural_flows(language, text)}
    assert found == meaning(language, body, marks), text


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(flow.SOURCES)), st.lists(st.sampled_from(["req.body", "eval(", "(", ")", "{", "}", "[", "]", "a", "=", ",", ";", "\n", "  ", "'", '"', "`", "${", "=>", ":", "def f", "end", "if", "x.y", "\\", "/", "//", "/*", "$_GET", "for", "in", "1"]), max_size=40))
def test_any_text(language, words):
    """Nothing is refused, and what is said twice is said once."""
    found = flow.structural_flows(language, "".join(words))
    assert len(found) == len(set(found))


def test_table(spark):
    text, want = GOLDEN["javascript"]
    rows = [("a.js", "javascript", text, "clash"), ("a.js", "javascript", text, "clash"), ("n", None, text, "x"), ("m", "javascript", None, "x"), ("u", "cobol", text, "x"), ("e", "java", "", "x")]
    found = flow.structure_flows(spark.createDataFrame(rows, "path string, language string, content string, sink string"))
    assert found.count() == 2 * len(want) and {r.path for r in found.collect()} == {"a.js"}
    for language, (text, want) in GOLDEN.items():
        assert flow.structure_flows(spark.createDataFrame([("f", language, text)], "path string, language string, content string")).count() == len(want), language


def test_only_texts_with_words_of_a_source_and_a_sink_are_read():
    assert not flow.may_flow("javascript", "el.innerHTML = request; document.write(x)") and flow.structural_flows("javascript", "el.innerHTML = request; document.write(x)") == []
    assert flow.may_flow("javascript", "const q = req\n  .query;\neval(q)") and flow.structural_flows("javascript", "const q = req\n  .query;\neval(q)")
    assert not flow.may_flow("cobol", "eval(req.query)")
    for language, needles in flow.SOURCES.items():
        for source in needles:
            for sink, _ in flow.SINKS[language]:
                assert flow.may_flow(language, f"{source} {sink}")
