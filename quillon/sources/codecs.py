"""Wire forms of a resource: JSON, XML and Turtle.

The functions work on one resource; converted() applies a pair of them to a column
in Arrow batches, for their grammars are recursive and have no column form.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from json.decoder import scanstring
from json.encoder import encode_basestring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Invalid

FHIR = "http://hl7.org/fhir"
XHTML = "http://www.w3.org/1999/xhtml"


def _scalar(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return str(value)


# -- XML: primitives are value attributes, arrays repeat their element, keys that begin with "_" are left out


def to_xml(resource: dict) -> str:
    if not resource.get("resourceType"):
        raise Invalid("a resource has a resourceType")
    if (body := _written(resource)) is not None:
        return f'<?xml version="1.0" encoding="UTF-8"?>{body}'
    root = ET.Element(resource["resourceType"], xmlns=FHIR)
    _fill(root, resource)
    return '<?xml version="1.0" encoding="UTF-8"?>' + ET.tostring(root, encoding="unicode")


_ESCAPED = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})
_special = re.compile('[&<>"\r\n\t]').search


def _written(resource: dict) -> str | None:
    """What _fill() and tostring() give, without a tree; None where there is a div, or a name that a tree has its own way with."""
    out: list[str] = []

    def put(value: dict) -> bool:
        for key, inner in value.items():
            if key.startswith("_") or key == "resourceType":
                continue
            if key == "div" or key.startswith("{"):
                return False
            for item in inner if isinstance(inner, list) else [inner]:
                if item is None:
                    continue
                if not isinstance(item, dict):
                    text = item if isinstance(item, str) else _scalar(item)
                    out.append(f'<{key} value="{text.translate(_ESCAPED) if _special(text) else text}" />')
                elif "resourceType" in item:
                    out.append(f"<{key}>")
                    if not element(item["resourceType"], "", item):
                        return False
                    out.append(f"</{key}>")
                elif not element(key, "", item):
                    return False
        return True

    def element(name, attributes: str, value: dict) -> bool:
        if not isinstance(name, str) or name[:1] == "{":
            return False
        at = len(out)
        out.append(f"<{name}{attributes}>")
        if not put(value):
            return False
        if len(out) == at + 1:
            out[at] = f"<{name}{attributes} />"
        else:
            out.append(f"</{name}>")
        return True

    return "".join(out) if element(resource["resourceType"], f' xmlns="{FHIR}"', resource) else None


def _fill(element: ET.Element, value: dict) -> None:
    for key, inner in value.items():
        if key.startswith("_") or key == "resourceType":
            continue
        for item in inner if isinstance(inner, list) else [inner]:
            if item is None:
                continue
            if key == "div" and isinstance(item, str):
                try:
                    ET.register_namespace("", XHTML)
                    element.append(ET.fromstring(item))
                except ET.ParseError:
                    ET.SubElement(element, key).text = item
                continue
            child = ET.SubElement(element, key)
            if isinstance(item, dict):
                if "resourceType" in item:
                    child = ET.SubElement(child, item["resourceType"])
                _fill(child, item)
            else:
                child.set("value", _scalar(item))


def from_xml(text: str) -> dict:
    """Primitives come back as strings, and an element that occurs once as no array: XML alone says no more."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise Invalid(f"not XML: {e}") from e
    return {"resourceType": _name(root)} | _object(root)


def _name(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


_DIV = f"{{{XHTML}}}div"


def _object(element: ET.Element) -> dict:
    out: dict = {}
    for child in element:
        key, n = _name(child), len(child)
        if child.tag == _DIV:
            value = ET.tostring(child, encoding="unicode")
        elif not n and (value := child.get("value")) is not None:
            pass
        elif n == 1 and _name(child[0])[:1].isupper():
            value = {"resourceType": _name(child[0])} | _object(child[0])
        else:
            value = _object(child)
            if (url := child.get("url")) is not None:
                value = {"url": url} | value
        if key in out:
            out[key] = [*(out[key] if isinstance(out[key], list) else [out[key]]), value]
        else:
            out[key] = value
    return out


# -- Turtle: objects are blank nodes, arrays collections, keys sorted

_PREFIX = "@prefix fhir: <http://hl7.org/fhir/> ."


def to_turtle(resource: dict) -> str:
    if not resource.get("resourceType"):
        raise Invalid("a resource has a resourceType")
    own = {k: v for k, v in resource.items() if k != "resourceType"}
    return f"{_PREFIX}\n\n[ a fhir:{resource['resourceType']}{_pairs(own)} ] .\n"


def _pairs(value: dict) -> str:
    return "".join(f" ; fhir:{k} {_term(value[k])}" for k in sorted(value))


def _term(value) -> str:
    if isinstance(value, dict):
        inner = _pairs(value)
        return f"[{inner[2:]} ]" if inner else "[ ]"
    if isinstance(value, list):
        return "( " + "".join(f"{_term(v)} " for v in value) + ")"
    if value is None:
        return '""'
    if isinstance(value, str):
        return encode_basestring(value)
    return _scalar(value) if not isinstance(value, float) or value.is_integer() else repr(value)


#: A token, or nothing where there is something that is none.
_TURTLE = re.compile(r'\s*(?:@prefix[^\n]*\.\s*\n|#[^\n]*\n)*\s*(?:("(?:[^"\\]|\\.)*"|[A-Za-z_][\w-]*:[\w.-]*[\w-]|[A-Za-z_][\w-]*:|[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|a\b|[\[\]();.])|\S)')


def _value(text: str, following):
    """The value that begins with a token; ``following`` takes the next one."""
    if text[0] == '"':
        return scanstring(text, 1)[0]
    if text == "[":
        return _resource(following)
    if text == "(":
        out = []
        while (text := following()) != ")":
            out.append(_value(text, following))
        return out
    if text[0] in "+-" or text[0].isdigit():
        return float(text) if "." in text or "e" in text or "E" in text else int(text)
    if text in ("true", "false"):
        return text == "true"
    raise Invalid(f"Turtle: {text} is no value")


def _resource(following) -> dict:
    out: dict = {}
    while (name := following()) != "]":
        if name == ";":
            continue
        if name == "a":
            out["resourceType"] = following().split(":", 1)[1]
        else:
            out[name.split(":", 1)[-1]] = _value(following(), following)
    return out


def from_turtle(text: str) -> dict:
    tokens = _TURTLE.findall(text)
    if "" in tokens:
        at = next(m.end() - 1 for m in _TURTLE.finditer(text) if m[1] is None)
        raise Invalid(f"not Turtle: {text[at : at + 30]!r}")
    if tokens[:1] != ["["]:
        raise Invalid("Turtle: [ expected")
    try:
        out = _resource(iter(tokens[1:]).__next__)
    except StopIteration as e:
        raise Invalid("Turtle ends too early") from e
    if "resourceType" not in out:
        raise Invalid("Turtle names no type")
    return out


_ENCODE = {"json": json.JSONEncoder(ensure_ascii=False).encode, "xml": to_xml, "turtle": to_turtle}
_DECODE = {"json": json.loads, "xml": from_xml, "turtle": from_turtle}


def converted(column: Column, source: str, target: str) -> Column:
    """A column of resources in another wire form; null where one cannot be read."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else _ENCODE[target](_DECODE[source](text))
            except (Invalid, ValueError):
                return None

        return texts.map(one)

    return convert(column)


def negotiate(format: str | None = None, accept: str | None = None) -> str:
    """json, xml or turtle: the _format parameter before the Accept header, JSON by default."""
    for wanted in (format, accept):
        for part in (wanted or "").lower().split(","):
            if "xml" in part:
                return "xml"
            if "turtle" in part or part.strip() == "ttl":
                return "turtle"
            if "json" in part:
                return "json"
    return "json"
