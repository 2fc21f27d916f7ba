"""Hand-written parsers that report every syntax error of a file."""

from __future__ import annotations

from millrace.functions.scalars import SUFFIX_LANGUAGE as LANGUAGE
from millrace.llm.syntax import ecma, golang, python
from millrace.llm.syntax.base import Problem, deep



def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def problems(text: str, path: str) -> list[Problem] | None:
    """The syntax errors of a file by the language of its suffix, in order; None if that is not judged."""
    suffix = suffix_of(path)
    if suffix not in LANGUAGE:
        return None
    with deep():
        if suffix in (".py", ".pyi"):
            return python.problems(text)
        if suffix == ".go":
            return golang.problems(text.removeprefix("﻿"))
        return ecma.problems(text.removeprefix("﻿"), suffix in (".ts", ".tsx"), suffix != ".ts")
