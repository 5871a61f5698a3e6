"""Re-indent one JSON text without changing its keys, their order, or how numbers are written."""

from __future__ import annotations

import json
import re

from loglane.functions.text import WHITE_SPACE

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def _refuse(name: str) -> None:
    raise ValueError(name)


def indent_json(text: str, indent: str) -> str:
    body = text.strip(WHITE_SPACE)
    try:
        json.loads(body, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return text
    out: list[str] = []
    depth, previous = 0, ""
    for token in _TOKEN.findall(body):
        if token in "}]":
            depth -= 1
            if previous not in "{[":
                out.append("\n" + indent * depth)
        elif previous and previous in "{[,":
            out.append("\n" + indent * depth)
        out.append(": " if token == ":" else token)
        if token in "{[":
            depth += 1
        previous = token
    return "".join(out)
