"""Taint flow inside a file: where data enters, how it is copied, what cleanses it, and where it does harm.

A flow is a chain of assignments, each line after line, so a file is read once
from top to bottom by a small function on Arrow batches; files without any
source never reach it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.functions.spans import code_of

#: Where data enters, by language.
SOURCES = {
    "javascript": ("req.body", "req.query", "req.params", "req.headers", "document.location", "window.location", "document.cookie", "process.env", "localStorage.getItem", "document.getElementById"),
    "typescript": ("req.body", "req.query", "req.params", "req.headers", "process.env"),
    "python": ("request.form", "request.args", "request.json", "request.data", "request.GET", "request.POST", "input()", "os.environ", "sys.argv"),
    "java": ("request.getParameter", "request.getHeader", "request.getInputStream", "@RequestParam", "@RequestBody", "@PathVariable", "Scanner.nextLine"),
    "go": ("r.URL.Query", "r.FormValue", "r.Body", "r.Header.Get", "os.Args", "os.Getenv"),
    "c": ("argv", "scanf", "gets", "fgets", "getenv", "recv"),
    "cpp": ("argv", "cin", "getline", "getenv"),
    "csharp": ("Request.QueryString", "Request.Form", "Request.Headers"),
    "php": ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER", "$_FILES"),
    "ruby": ("params", "request.body", "request.headers", "ENV"),
    "rust": ("std::env::args", "std::io::stdin", "std::env::var"),
    "kotlin": ("request.queryParams", "call.receive"),
    "swift": ("URLRequest", "UserDefaults"),
}
#: Where data does harm, and the kind of harm, by language.
SINKS = {
    "javascript": (("eval(", "code_injection"), ("innerHTML", "xss"), ("document.write(", "xss"), ("exec(", "command_injection"), ("execSync(", "command_injection"), ("query(", "sql_injection"), ("raw(", "sql_injection")),
    "typescript": (("eval(", "code_injection"), ("innerHTML", "xss"), ("exec(", "command_injection"), ("query(", "sql_injection")),
    "python": (("eval(", "code_injection"), ("exec(", "code_injection"), ("os.system(", "command_injection"), ("subprocess.call(", "command_injection"), ("cursor.execute(", "sql_injection"), ("open(", "path_traversal"), ("pickle.loads(", "deserialization")),
    "java": (("Runtime.exec(", "command_injection"), ("Statement.execute(", "sql_injection"), ("Statement.executeQuery(", "sql_injection"), ("new File(", "path_traversal"), ("ObjectInputStream.readObject", "deserialization")),
    "go": (("exec.Command(", "command_injection"), ("db.Query(", "sql_injection"), ("db.Exec(", "sql_injection"), ("fmt.Fprintf(", "xss"), ("template.HTML(", "xss"), ("os.Open(", "path_traversal")),
    "c": (("system(", "command_injection"), ("exec(", "command_injection"), ("printf(", "format_string"), ("strcpy(", "buffer_overflow"), ("strcat(", "buffer_overflow")),
    "cpp": (("system(", "command_injection"), ("strcpy(", "buffer_overflow"), ("sprintf(", "buffer_overflow")),
    "csharp": (("Process.Start(", "command_injection"), ("SqlCommand(", "sql_injection")),
    "php": (("eval(", "code_injection"), ("exec(", "command_injection"), ("system(", "command_injection"), ("mysql_query(", "sql_injection"), ("echo ", "xss"), ("include(", "file_inclusion")),
    "ruby": (("eval(", "code_injection"), ("system(", "command_injection"), ("exec(", "command_injection"), (".where(", "sql_injection"), ("raw(", "xss"), ("Marshal.load(", "deserialization")),
    "rust": (("Command::new(", "command_injection"), ("format!(", "format_string")),
    "kotlin": (("Runtime.exec(", "command_injection"), ("createQuery(", "sql_injection")),
    "swift": (("Process.launch", "command_injection"),),
}
#: What cleanses data, and of which kinds of harm, by language.
CLEANSERS = {
    "javascript": (("encodeURIComponent(", ("xss",)), ("escape(", ("xss", "sql_injection")), ("DOMPurify.sanitize(", ("xss",)), ("parseInt(", ("sql_injection", "xss"))),
    "typescript": (("encodeURIComponent(", ("xss",)), ("parseInt(", ("sql_injection", "xss"))),
    "python": (("bleach.clean(", ("xss",)), ("escape(", ("xss",)), ("int(", ("sql_injection",)), ("shlex.quote(", ("command_injection",))),
    "java": (("PreparedStatement", ("sql_injection",)), ("Integer.parseInt(", ("sql_injection",)), ("ESAPI.encoder().encodeForHTML(", ("xss",))),
    "go": (("template.HTMLEscapeString(", ("xss",)), ("url.QueryEscape(", ("xss",)), ("strconv.Atoi(", ("sql_injection",))),
    "csharp": (("HttpUtility.HtmlEncode(", ("xss",)),),
    "php": (("htmlspecialchars(", ("xss",)), ("mysqli_real_escape_string(", ("sql_injection",)), ("intval(", ("sql_injection",))),
    "ruby": (("sanitize(", ("xss",)), ("h(", ("xss",))),
}

ASSIGNED = re.compile(r"^(?:(?:const|let|var|val|final|String|int|auto|char\s*\*)\s+)?(\$?\w+)\s*(?::\s*\w+\s*)?:?=(?!=)\s*(.*)$")
COMMENT = re.compile(r"^(?://|#|\*|/\*)")
COLUMNS = "path string, language string, source string, source_line int, sink string, sink_kind string, sink_line int, steps int"


@dataclass(frozen=True)
class Taint:
    """What a variable carries: its source, the copies since, and the kinds of harm it is cleansed of."""

    source: str
    line: int
    steps: int
    clean: frozenset[str]


def holds(code: str, needle: str) -> bool:
    """Whether code calls or names something.  ``Class.method`` is also met where the method is called on an object."""
    if needle[:1].isupper() and "." in needle:
        return needle in code or "." + needle.rsplit(".", 1)[1] in code
    at = code.find(needle)
    while at >= 0:
        if at == 0 or not (needle[0].isalnum() and (code[at - 1].isalnum() or code[at - 1] == "_")):
            return True
        at = code.find(needle, at + 1)
    return False


def flows(language: str, content: str) -> Iterator[tuple[str, int, str, str, int, int]]:
    """source, source line, sink, kind, sink line and steps of every flow of one file."""
    tainted: dict[str, list[Taint]] = {}
    for number, raw in enumerate(content.split("\n"), 1):
        code = code_of(raw).strip()
        if not code or COMMENT.match(code):
            continue
        found = ASSIGNED.match(code)
        to, value = (found[1], found[2]) if found else ("", code)
        clean = frozenset(k for needle, kinds in CLEANSERS.get(language, ()) if holds(value, needle) for k in kinds)
        carried = [Taint(s, number, 0, clean) for s in SOURCES[language] if holds(value, s)]
        for word in dict.fromkeys(re.findall(r"\$?\w+", value)):
            carried += [Taint(t.source, t.line, t.steps, t.clean | clean) for t in tainted.get(word, ())]
        for sink, kind in SINKS[language]:
            if holds(code, sink):
                yield from ((t.source, t.line, sink, kind, number, t.steps) for t in dict.fromkeys(carried) if kind not in t.clean)
        if to:
            # One chain of each source is enough: the shortest.
            best: dict[str, Taint] = {}
            for t in carried:
                held = Taint(t.source, t.line, t.steps + (t.line != number), t.clean)
                if t.source not in best or (len(held.clean), held.steps) < (len(best[t.source].clean), best[t.source].steps):
                    best[t.source] = held
            tainted[to] = list(best.values())


def taint_flows(files: DataFrame) -> DataFrame:
    """path, language, source, source_line, sink, sink_kind, sink_line and steps of each flow into a sink (path, language, content).

    A variable is tainted from the line that assigns it a source or a tainted
    variable, until it is assigned something else; a cleanser ends the kinds of
    harm it cleanses.  Every source, variable and sink of a line counts.  steps:
    the copies between.  Null contents and other languages give no flows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                rows += [(path, language, s, line, sink, kind, at, steps) for s, line, sink, kind, at, steps in flows(language, content)]
            if rows:
                types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    names = F.create_map(*(F.lit(x) for language, values in SOURCES.items() for x in (language, "|".join(re.escape(v) for v in values))))
    some = files.where(F.rlike("content", F.try_element_at(names, F.col("language"))))
    return some.select("path", "language", "content").mapInArrow(run, COLUMNS)


#: Severity and weakness of each kind of sink; others are high.
KINDS = (
    ("code_injection", "critical", "CWE-94"), ("command_injection", "critical", "CWE-78"), ("sql_injection", "critical", "CWE-89"), ("xss", "high", "CWE-79"),
    ("path_traversal", "high", "CWE-22"), ("deserialization", "critical", "CWE-502"), ("file_inclusion", "critical", "CWE-98"), ("format_string", "high", "CWE-134"), ("buffer_overflow", "critical", "CWE-120"),
)


def taint_findings(found: DataFrame) -> DataFrame:
    """A finding for each flow."""
    table = found.sparkSession.createDataFrame(list(KINDS), "sink_kind string, severity string, cwe string")
    joined = found.join(F.broadcast(table), "sink_kind", "left")
    return joined.select("path", F.col("sink_line").alias("line_no"), F.concat(F.lit("security/taint-"), "sink_kind").alias("rule_id"), F.coalesce("severity", F.lit("high")).alias("severity"), F.lit("taint-flow").alias("category"), F.lit("high").alias("confidence"), "cwe", "source", "source_line", "sink", "steps")
