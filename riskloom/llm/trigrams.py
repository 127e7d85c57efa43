"""Boolean trigram queries of regular expressions.

``trigram_query`` gives a condition that every text matching the pattern fulfils: nested
``("and", parts)``, ``("or", parts)`` and ``("has", trigram)``, or None where the pattern names no
trigram that must occur. Trigrams are lower-case, to be looked up in the lower-cased text, so the
condition holds whatever the case of the match.
"""

import re

Query = tuple | None


def _all_of(parts: list[Query]) -> Query:
    known = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not known else known[0] if len(known) == 1 else ("and", tuple(known))


def _one_of(parts: list[Query]) -> Query:
    """An alternative that demands nothing makes the whole choice demand nothing."""
    if any(p is None for p in parts):
        return None
    known = list(dict.fromkeys(parts))
    return known[0] if len(known) == 1 else ("or", tuple(known))


def _of_run(run: str) -> Query:
    run = run.lower()
    return _all_of([("has", run[i:i + 3]) for i in range(len(run) - 2)])


def _of_tree(tree) -> Query:
    parts, run = [], ""

    def close() -> None:
        nonlocal run
        parts.append(_of_run(run))
        run = ""

    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL" and arg < 128:
            run += chr(arg)
            continue
        close()
        if kind == "SUBPATTERN":
            parts.append(_of_tree(arg[-1]))
        elif kind == "BRANCH":
            parts.append(_one_of([_of_tree(b) for b in arg[1]]))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            parts.append(_of_tree(arg[2]))
    close()
    return _all_of(parts)


def trigram_query(pattern: str) -> Query:
    return _of_tree(re._parser.parse(pattern))


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "has" else set().union(*(trigrams(p) for p in query[1]))
