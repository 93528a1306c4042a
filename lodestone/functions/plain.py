"""Quick reading of the plain part of YAML and of TOML, in which tools write nearly all lock files.

Both give None for any text that has something else in it or that may be wrong, and leave it to the whole parser. What they
do read they read as that parser does; tests hold the two against each other.
"""

from __future__ import annotations

import re

_ODD = re.compile(r"[^\n -~]")

# YAML: block mappings and lists of plain scalars and of quoted ones without escapes, a line each.
_QUOTED = r"""\"[^"\\\n]*+\"|'[^'\n]*+'"""
_PLAIN = r"[A-Za-z0-9_/(~^=+$][^\s:#]*+(?:[ :#][^\s:#]++)*+"
_LINE = re.compile(rf"^( *+)(- )?+(?:({_PLAIN}|{_QUOTED}):(?: ({_PLAIN}|{_QUOTED}))?|({_PLAIN}|{_QUOTED}))$|^ *#.*$|^(.+)$", re.M)
#: PyYAML gives up on longer keys.
_KEY = 1000


def _bare(text: str) -> str:
    return text[1:-1] if text[0] in "\"'" else text


def plain_yaml(text: str) -> dict | None:
    """The mapping that a YAML text is, every scalar a string; None if it must be parsed as a whole."""
    if _ODD.search(text):
        return None
    root: dict = {}
    # Open mappings and lists by the column they stand in; a key without a value waits for the next line to tell what it holds.
    open_, columns, waiting = [root], [0], None
    for indent, dash, key, value, item, bad in _LINE.findall(text):
        if not (key or item):
            if bad:
                return None
            continue
        column = len(indent)
        if waiting is not None:
            inside = column > columns[-1] or (dash and column == columns[-1])
            if inside:
                made: dict | list = [] if dash else {}
                open_[-1][waiting] = made
                open_.append(made)
                columns.append(column)
            waiting = None
        while column < columns[-1] or (column == columns[-1] and not dash and isinstance(open_[-1], list)):
            open_.pop()
            columns.pop()
            if not columns:
                return None
        here = open_[-1]
        if column != columns[-1] or isinstance(here, list) != bool(dash):
            return None
        if dash:
            if item:
                here.append(_bare(item))
                continue
            made = {}
            here.append(made)
            open_.append(made)
            columns.append(column + 2)
            here = made
        elif item:
            return None
        if len(key) > _KEY:
            return None
        key = _bare(key)
        if value:
            here[key] = _bare(value)
        else:
            here[key] = ""
            waiting = key
    return root or None


# TOML: tables with bare names, strings without escapes, whole numbers, and arrays of strings or of tables in one line.
_STRING = r'"[^"\\\n]*"'
_PAIR = rf"[A-Za-z0-9_-]+ = {_STRING}"
_TABLE = rf"\{{ ?{_PAIR}(?:, {_PAIR})* ?\}}"
_ITEM = rf"(?:{_STRING}|{_TABLE})"
_ARRAY = rf"\[\s*(?:{_ITEM}(?:,\s*{_ITEM})*,?\s*)?\]"
_ENTRY = re.compile(rf'^([A-Za-z0-9_-]+|{_STRING}) = (?:({_STRING})|({_ARRAY}|{_TABLE})|(true|false|0|[1-9][0-9]{{0,17}}))$|^(\[\[?)([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*)(\]\]?)$|^#.*$|^(.+)$', re.M)
_ITEMS, _TEXTS, _PAIRS = re.compile(_ITEM), re.compile(r'"([^"]*)"'), re.compile(r'([A-Za-z0-9_-]+) = "([^"]*)"')


class _Twice(Exception):
    pass


def _table(text: str) -> dict:
    pairs = _PAIRS.findall(text)
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Twice
    return out


def _compound(text: str) -> object:
    if text[0] == "{":
        return _table(text)
    if "{" not in text:
        return _TEXTS.findall(text)
    return [_table(x) if x[0] == "{" else x[1:-1] for x in _ITEMS.findall(text)]


def plain_toml(text: str) -> dict | None:
    """The table that a TOML text is; None if it must be parsed as a whole."""
    if _ODD.search(text):
        return None
    root: dict = {}
    here, headed = root, {id(root)}
    try:
        for key, string, compound, atom, opening, path, closing, bad in _ENTRY.findall(text):
            if key:
                if key[0] == '"':
                    key = key[1:-1]
                if key in here:
                    return None
                here[key] = string[1:-1] if string else _compound(compound) if compound else atom == "true" if atom in ("true", "false") else int(atom)
            elif path:
                if len(opening) != len(closing):
                    return None
                here = root
                *above, last = path.split(".")
                for name in above:
                    if name not in here:
                        here[name] = {}
                        headed.add(id(here[name]))
                    here = here[name]
                    if id(here) not in headed:
                        return None
                    if isinstance(here, list):
                        here = here[-1]
                made: dict = {}
                if len(opening) == 1:
                    if last in here:
                        return None
                    here[last] = made
                else:
                    if last not in here:
                        here[last] = []
                        headed.add(id(here[last]))
                    if id(here[last]) not in headed or not isinstance(here[last], list):
                        return None
                    here[last].append(made)
                headed.add(id(made))
                here = made
            elif bad:
                return None
    except _Twice:
        return None
    return root
