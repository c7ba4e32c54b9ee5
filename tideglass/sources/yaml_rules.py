"""Detection rules as YAML texts: fields, platforms, techniques, detection keys, licence, hash, and errors by rule.

A rule is small and files are many, so rules are parsed in batches where they are read. The reader knows the part of
YAML that rules are written in: block mappings and sequences, flow ones, plain, quoted and block scalars, comments.
Anchors, aliases, tags, tabs as indentation and several documents in one text are errors of that rule and of no other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
STATUS = ("stable", "test", "experimental", "deprecated", "unsupported")
LEVELS = ("informational", "low", "medium", "high", "critical")
LICENCES = ("MIT", "Apache-2.0", "Apache 2.0", "DRL", "CC-BY-4.0", "CC0-1.0", "BSD-3-Clause", "BSD-2-Clause")
PRODUCTS = {"windows": ["windows"], "linux": ["linux"], "macos": ["macos"], "aws": ["aws"], "azure": ["azure"], "gcp": ["gcp"], "okta": ["okta"], "office365": ["office365"], "apache": ["linux", "windows"], "nginx": ["linux", "windows"]}
SERVICES = {"sysmon": ["windows"], "powershell": ["windows"], "security": ["windows"], "system": ["windows"], "application": ["windows"], "sshd": ["linux"], "auth": ["linux"], "auditd": ["linux"]}

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{}#&*!|>'"%@`,-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", " ": " "}


class YamlError(ValueError):
    """What is wrong, and in which line (from 1)."""

    def __init__(self, line: int, why: str):
        super().__init__(f"line {line}: {why}")


def _bare(line: str) -> str:
    """A line without its comment: `#` after white space (or first), outside quotes."""
    quote, i = "", 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\" and quote == '"' or c == quote == "'" and line[i + 1 : i + 2] == "'":
                i += 1  # an escaped character, or a quote written twice
            elif c == quote:
                quote = ""
        elif c in "'\"" and (i == 0 or line[i - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
        i += 1
    return line.rstrip()


def plain(text: str) -> Any:
    """A plain scalar: null, a truth value, a number or a string."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", text):
        return float(text)
    return text


class _Flow:
    """Scalars and flow collections of one run of text."""

    def __init__(self, text: str, line: int):
        self.text, self.line, self.at = text, line, 0

    def fail(self, why: str) -> YamlError:
        return YamlError(self.line, why)

    def skip(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, inside: bool = False) -> Any:
        c = self.skip()
        if c and c in "&*!@`%":
            raise self.fail(f"{c} is not supported")
        if c == "[":
            return self.items("]", lambda: self.value(True))
        if c == "{":
            return dict(self.items("}", self.pair))
        if c and c in "'\"":
            return self.quoted(c)
        stop = re.compile(r"[,\[\]{}]|:(?=\s|$)" if inside else r"\Z").search(self.text, self.at)
        end = stop.start() if stop else len(self.text)
        found, self.at = self.text[self.at : end].strip(), end
        return plain(found)

    def items(self, end: str, one) -> list:
        self.at += 1
        out = []
        while (c := self.skip()) != end:
            if not c:
                raise self.fail(f"{end} is missing")
            out.append(one())
            if (c := self.skip()) == ",":
                self.at += 1
            elif c != end:
                raise self.fail(f"{end} or a comma is missing")
        self.at += 1
        return out

    def pair(self) -> tuple:
        key = self.value(True)
        if self.skip() != ":":
            return key, None
        self.at += 1
        return key, None if self.skip() in (",", "}") else self.value(True)

    def quoted(self, quote: str) -> str:
        m = re.compile(r"'((?:[^']|'')*)'" if quote == "'" else r'"((?:[^"\\]|\\.)*)"', re.S).match(self.text, self.at)
        if not m:
            raise self.fail("a quote is not closed")
        self.at = m.end()
        if quote == "'":
            return m[1].replace("''", "'")
        code = lambda e: chr(int(e[1][1:], 16)) if e[1][0] in "xuU" and len(e[1]) > 1 else _ESCAPES.get(e[1], e[1])
        return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", code, m[1], flags=re.S)

    def whole(self) -> Any:
        found = self.value()
        if self.skip():
            raise self.fail(f"unexpected {self.text[self.at :][:20]!r}")
        return found


class _Blocks:
    """Block structure by indentation."""

    def __init__(self, text: str):
        self.raw = text.replace("\r\n", "\n").split("\n")
        self.lines = [(i, len(b) - len(b.lstrip(" ")), b.lstrip(" ")) for i, r in enumerate(self.raw) if (b := _bare(r)).strip()]
        self.at = 0

    def document(self) -> Any:
        if self.lines and self.lines[0][2] == "---":
            self.at = 1
        found = self.node(0) if self.at < len(self.lines) else None
        if self.at < len(self.lines) and self.lines[self.at][2] != "...":
            raise YamlError(self.lines[self.at][0] + 1, "unexpected indentation or a second document")
        return found

    def node(self, least: int) -> Any:
        """What stands at the next line, if it is indented by at least so much; null if not."""
        if self.at >= len(self.lines) or self.lines[self.at][1] < least:
            return None
        number, indent, body = self.lines[self.at]
        if body.startswith("\t"):
            raise YamlError(number + 1, "a tab indents")
        if body == "-" or body.startswith("- "):
            return self.sequence(indent)
        if _KEY.match(body):
            return self.mapping(indent)
        return self.scalar(body, number, indent - 1)

    def sequence(self, indent: int) -> list:
        out = []
        while self.at < len(self.lines) and self.lines[self.at][1] == indent and (self.lines[self.at][2] + " ").startswith("- "):
            number, _, body = self.lines[self.at]
            rest = body[1:].lstrip(" ")
            if not rest:
                self.at += 1
                out.append(self.node(indent + 1))
            elif _KEY.match(rest) or (rest + " ").startswith("- "):
                # What follows the dash is a block of its own, indented to where it stands.
                self.lines[self.at] = (number, indent + len(body) - len(rest), rest)
                out.append(self.node(indent + 1))
            else:
                out.append(self.scalar(rest, number, indent))
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while self.at < len(self.lines) and self.lines[self.at][1] == indent:
            number, _, body = self.lines[self.at]
            m = _KEY.match(body)
            if not m:
                raise YamlError(number + 1, "a key is missing")
            key = _Flow(m[1], number + 1).whole()
            if key in out:
                raise YamlError(number + 1, f"{key} stands twice")
            rest = body[m.end() :].strip()
            if rest:
                out[key] = self.scalar(rest, number, indent)
            else:
                self.at += 1
                # A sequence may stand under its key without being indented.
                here = self.at < len(self.lines) and self.lines[self.at][1] == indent and (self.lines[self.at][2] + " ").startswith("- ")
                out[key] = self.sequence(indent) if here else self.node(indent + 1)
        return out

    def scalar(self, body: str, number: int, indent: int) -> Any:
        """A scalar or flow collection that begins in a line of this indentation and may go on in deeper ones."""
        self.at += 1
        if m := re.fullmatch(r"([|>])([+-]?)(\d?)([+-]?)", body):
            return self.block(m[1], m[2] + m[4], number, indent)
        last = number
        while self.at < len(self.lines) and self.lines[self.at][1] > indent and not (body[0] not in "[{'\"" and _KEY.match(self.lines[self.at][2])):
            if body[0] in "[{'\"":
                try:
                    return _Flow(body, number + 1).whole()
                except YamlError:
                    pass
            last = self.lines[self.at][0]
            body += " " + self.lines[self.at][2]
            self.at += 1
        return _Flow(body, last + 1).whole()

    def block(self, style: str, chomp: str, number: int, indent: int) -> str:
        end = number + 1
        while end < len(self.raw) and (not self.raw[end].strip() or len(self.raw[end]) - len(self.raw[end].lstrip(" ")) > indent):
            end += 1
        rows = self.raw[number + 1 : end]
        margin = min((len(r) - len(r.lstrip(" ")) for r in rows if r.strip()), default=0)
        rows = [r[margin:] for r in rows]
        while self.at < len(self.lines) and self.lines[self.at][0] < end:
            self.at += 1
        text = "\n".join(rows)
        tail = "" if chomp == "-" else "\n"
        body = text.rstrip("\n")
        if style == ">":
            body = re.sub(r"(?<!\n)\n(?!\n)", " ", body)
            body = re.sub(r"\n\n", "\n", body)
        return body + (text[len(text.rstrip("\n")) :] + "\n" if chomp == "+" else tail if body else "")


def parse(text: str) -> Any:
    """The value of a YAML text; YamlError tells where it isn't one."""
    return _Blocks(text).document()


def detection_keys(detection: Any) -> set[str]:
    """Field names of a detection, however deep: those of mappings below its items. Names with a leading underscore,
    conditions and time frames are none."""
    found: set[str] = set()

    def walk(value: Any, fields: bool) -> None:
        if isinstance(value, dict):
            for key, inner in value.items():
                if not fields and key in ("condition", "timeframe"):
                    continue
                if fields and isinstance(key, str) and not key.startswith("_"):
                    found.add(key)
                walk(inner, True)
        elif isinstance(value, list):
            for inner in value:
                walk(inner, True)

    walk(detection, False)
    return found


def condition_names(condition: str, items: set[str]) -> set[str]:
    """Items that a condition rests on: names joined by and, or, not and parentheses, `1 of` and `all of` a pattern or
    them. What follows a pipe (an aggregation) is left out. Unknown names and broken conditions are errors."""
    words = re.findall(r"[()]|[^\s()]+", condition.split("|")[0])
    at, used = 0, set()

    def fits(pattern: str) -> set[str]:
        star = "" if pattern == "them" else pattern
        hit = {i for i in items if not i.startswith("_")} if not star else {i for i in items if re.fullmatch(re.escape(star).replace(r"\*", ".*"), i)}
        if not hit:
            raise ValueError(f"condition names {pattern}, which is not there")
        return hit

    def term() -> None:
        nonlocal at
        if at >= len(words):
            raise ValueError("condition breaks off")
        word = words[at]
        at += 1
        if word.lower() == "not":
            return term()
        if word == "(":
            either()
            if at >= len(words) or words[at] != ")":
                raise ValueError("condition lacks a parenthesis")
            at += 1
        elif at + 1 < len(words) and words[at].lower() == "of" and (word.isdigit() or word.lower() in ("all", "any")):
            used.update(fits(words[at + 1]))
            at += 2
        elif word == ")" or word.lower() in ("and", "or", "of"):
            raise ValueError(f"condition has {word} where a name must stand")
        else:
            used.update(fits(word))

    def either() -> None:
        nonlocal at
        term()
        while at < len(words) and words[at].lower() in ("and", "or"):
            at += 1
            term()

    either()
    if at < len(words):
        raise ValueError(f"condition goes on with {words[at]}")
    return used


FIELDS = ["title", "id", "status", "level", "license"]
SCHEMA = "path string, title string, id string, status string, level string, license string, platforms array<string>, techniques array<string>, keys array<string>, selections array<string>, sha256 string, errors array<string>"


def read(path: str, text: str | None, licences: bool = True) -> tuple:
    """One rule as a row of SCHEMA; errors are sorted."""
    errors: list[str] = []
    digest = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
    try:
        rule = parse(text or "")
        if not isinstance(rule, dict):
            raise ValueError("no rule")
    except (ValueError, RecursionError) as e:
        return (path, *[None] * 5, [], [], [], [], digest, [f"yaml: {e}" if isinstance(e, YamlError) else str(e)])
    one = {f: None if rule.get(f) is None else str(rule[f]) for f in FIELDS}
    one["status"] = one["status"] or "experimental"
    if one["title"] is None:
        errors.append("no title")
    if one["status"] not in STATUS:
        errors.append(f"unknown status: {one['status']}")
    if one["level"] is not None and one["level"] not in LEVELS:
        errors.append(f"unknown level: {one['level']}")
    if licences and "license" in rule and not any(name.upper() in (one["license"] or "").strip().upper() for name in LICENCES):
        errors.append(f"licence not allowed: {one['license']}")
    tags = rule.get("tags")
    if tags is not None and not isinstance(tags, list):
        errors.append("tags are no list")
        tags = None
    techniques = sorted({str(t)[len("attack.") :].upper() for t in tags or [] if str(t).lower().startswith("attack.t") and str(t)[8:9].isdigit()})
    source = rule.get("logsource") if isinstance(rule.get("logsource"), dict) else {}
    platforms = sorted({p for known, field in ((PRODUCTS, "product"), (SERVICES, "service")) for p in known.get(str(source.get(field) or "").lower(), [])})
    detection = rule.get("detection") if isinstance(rule.get("detection"), dict) else {}
    items = {str(k) for k in detection} - {"condition", "timeframe"}
    used: set[str] = set()
    for condition in detection.get("condition") if isinstance(detection.get("condition"), list) else [detection.get("condition")]:
        if condition is None:
            errors.append("no condition")
            continue
        try:
            used |= condition_names(str(condition), items)
        except ValueError as e:
            errors.append(str(e))
    return (path, *(one[f] for f in FIELDS), platforms, techniques, sorted(detection_keys(detection)), sorted(used), digest, sorted(errors))


def rules(files: DataFrame, licences: bool = True) -> DataFrame:
    """One row of SCHEMA for each file (path, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(p, t, licences) for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return files.select(files["path"].cast("string"), files["text"].cast("string")).mapInArrow(run, SCHEMA)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all files below a folder, one file a rule, through Spark's own readers."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml").text(path, wholetext=True)
    return rules(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


FUNCTIONS = {
    "p31_yaml_rules": (
        lambda files: rules(files).select("path", "title", "id", "status", "level", F.array_join("platforms", ",").alias("platforms"), F.array_join("techniques", ",").alias("techniques"), F.array_join("keys", ",").alias("keys"), F.array_join("selections", ",").alias("selections"), "sha256", F.array_join("errors", "; ").alias("errors")),
        ["rule_files"],
        """SELECT path, CASE WHEN p_size % 17 <> 0 THEN p_name END AS title, concat('r-', p_partkey) AS id, ['stable', 'test', 'broken', 'experimental'][p_size % 4 + 1] AS status, CASE WHEN p_size > 40 THEN 'urgent' ELSE 'high' END AS level,
        CASE p_size % 3 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux,windows' ELSE 'linux' END AS platforms, concat('T1', lpad(p_size::VARCHAR, 3, '0')) AS techniques, 'Brand,Image|endswith,Size,Type' AS keys, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'filter_b,sel_a' END AS selections, sha256(text) AS sha256,
        array_to_string(list_filter([CASE WHEN p_size % 5 = 0 THEN 'condition names sel_z, which is not there' END, CASE WHEN p_size % 7 = 0 THEN 'licence not allowed: Own' END, CASE WHEN p_size % 17 = 0 THEN 'no title' END, CASE WHEN p_size > 40 THEN 'unknown level: urgent' END, CASE WHEN p_size % 4 = 2 THEN 'unknown status: broken' END], lambda x: x IS NOT NULL), '; ') AS errors
        FROM rule_files JOIN part ON path = p_partkey::VARCHAR""",
    ),
}
