"""The entity vocabulary: one table of rules from which schemas, lint rules and folders follow."""

from __future__ import annotations

from pyspark.sql import types as T

# Types with their folder, whether it has year and month folders, and statuses (the first is the default).
TYPES = {
    "project": ("Entities/Projects", False, ("active", "draft", "completed", "archived", "superseded")),
    "company": ("Entities/Companies", False, ("target", "applied", "interviewing", "offered", "rejected", "hired", "archived", "superseded")),
    "concept": ("Concepts", False, ("active", "draft", "archived", "superseded")),
    "insight": ("Insights", True, ("draft", "active", "archived", "superseded")),
    "log": ("Logs", True, ("active", "archived", "superseded")),
    "profile": ("Profile", False, ("active", "draft", "archived", "superseded")),
}
# Enumerated fields.
ENUMS = {
    ("company", "size"): ("startup", "small", "medium", "large", "mega"),
    ("company", "resume_language"): ("ko", "en", "ja", "zh", "한국어", "English"),
    ("concept", "kind"): ("technology", "tool", "algorithm", "methodology"),
}
# Required fields of nested objects.
NESTED_REQUIRED = {("project", "metrics"): "name", ("company", "positions"): "title"}
# Relations in their order, with domain and range types (None: any).
RELATIONS = {
    "uses": (None, ("concept",)),
    "part_of": (None, None),
    "broader": (("concept",), ("concept",)),
    "decided_in": (None, ("insight", "log")),
    "supersedes": (None, None),
    "same_as": (None, None),
}
TRANSITIVE = ("part_of", "broader")
SYMMETRIC = ("same_as",)
OCCURRENTS = ("insight", "log")
CONTINUANTS = tuple(t for t in TYPES if t not in OCCURRENTS)
SUPERSEDED = "superseded"
# Kinds of concepts, in order of precedence, with their words.
KINDS = {
    "algorithm": ("알고리즘", "algorithm", "정렬", "sort", "탐색", "search", "heap", "complexity", "빅오", "big-o"),
    "methodology": ("방법론", "methodology", "원칙", "principle", "tdd", "solid", "process", "워크플로", "workflow"),
    "tool": ("도구", "tool", "cli", "플러그인", "plugin", "sdk", "프레임워크", "framework", "라이브러리", "library", "명령어"),
    "technology": ("기술", "technology", "동시성", "concurrency", "프로토콜", "protocol", "api", "런타임", "runtime"),
}
# Words of a text that ask for a relation (whole ASCII words; parts).
INTENTS = {
    "uses": (("uses",), ("사용",)),
    "decided_in": (("decided_in", "decision"), ("결정",)),
    "part_of": (("part_of",), ("속한", "상위")),
}

_TEXTS = ("role", "period_start", "period_end", "country", "size", "website", "resume_language", "notes", "last_reviewed", "kind", "question", "command", "summary", "scope")
_LISTS = ("domains", "stack", "keywords", "aliases")
_S, _L = T.StringType(), T.ArrayType(T.StringType())
ATTRS = T.StructType(
    [T.StructField(f, _S) for f in _TEXTS] + [T.StructField("confidence", T.DoubleType())] + [T.StructField(f, _L) for f in _LISTS]
    + [
        T.StructField("metrics", T.ArrayType(T.StructType([T.StructField(f, _S) for f in ("name", "before", "after", "value")]))),
        T.StructField("positions", T.ArrayType(T.StructType([T.StructField("title", _S), T.StructField("seniority", _S), T.StructField("keywords", _L), T.StructField("jd_url", _S)]))),
    ]
)
ENTITY = T.StructType(
    [T.StructField(f, _S) for f in ("slug", "title", "type", "status", "created", "updated", "observed_at", "t_invalid")]
    + [T.StructField(f, _L) for f in ("sources", "related", *RELATIONS)]
    + [T.StructField("attrs", ATTRS), T.StructField("body", _S), T.StructField("path", _S)]
)
EDGE = T.StructType([T.StructField("src_type", _S), T.StructField("src_slug", _S), T.StructField("src_ord", T.LongType()), T.StructField("relation", _S), T.StructField("pos", T.IntegerType()), T.StructField("target", _S)])
