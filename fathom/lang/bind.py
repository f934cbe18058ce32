"""From a parsed operation to one without variables, fragments or conditions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from ..errors import Forbidden, Unauthorized, ValidationError
from . import ast

_KINDS: dict[str, tuple[type, ...]] = {"String": (str,), "ID": (str, int), "Uuid": (str,), "Email": (str,), "URL": (str,), "PhoneNumber": (str,), "Int": (int,), "Float": (int, float), "Boolean": (bool,)}


def _fits(value: Any, kind: str) -> bool:
    if value is None:
        return True
    if kind.startswith("["):
        return isinstance(value, list) and all(_fits(v, kind[1:-1]) for v in value)
    want = _KINDS.get(kind)
    return want is None or isinstance(value, want) and (kind == "Boolean" or not isinstance(value, bool))


def variables(definitions: list[ast.VarDef], given: dict[str, Any] | None) -> dict[str, Any]:
    """Values by name: those given, else the defaults.  Without definitions, what is given."""
    given = dict(given or {})
    for d in definitions:
        if d.name not in given:
            if d.has_default:
                given[d.name] = d.default
            elif d.required:
                raise ValidationError(f"variable ${d.name} is required")
            else:
                given[d.name] = None
        if given[d.name] is None and d.required:
            raise ValidationError(f"variable ${d.name} may not be null")
        if not _fits(given[d.name], d.type):
            raise ValidationError(f"variable ${d.name} isn't of type {d.type}")
    return given


def resolve(x: Any, given: dict[str, Any]) -> Any:
    """x with all variables replaced, at any depth."""
    if isinstance(x, ast.Var):
        if x.name not in given:
            raise ValidationError(f"variable ${x.name} isn't defined")
        return given[x.name]
    if isinstance(x, dict):
        return {k: resolve(v, given) for k, v in x.items()}
    if isinstance(x, list):
        return [resolve(v, given) for v in x]
    return x


def resolve_expression(x: Any, given: dict[str, Any]) -> Any:
    if isinstance(x, ast.Var):
        return ast.Lit(resolve(x, given))
    if isinstance(x, ast.Call):
        return replace(x, args=tuple(resolve_expression(a, given) for a in x.args))
    if isinstance(x, ast.Binary):
        return replace(x, left=resolve_expression(x.left, given), right=resolve_expression(x.right, given))
    if isinstance(x, ast.Unary):
        return replace(x, operand=resolve_expression(x.operand, given))
    if isinstance(x, ast.Ternary):
        return ast.Ternary(*(resolve_expression(a, given) for a in (x.test, x.yes, x.no)))
    return x


def included(directives: list[ast.Directive], given: dict[str, Any]) -> bool:
    for d in directives:
        if d.name in ("include", "skip"):
            if "if" not in d.args:
                raise ValidationError(f"@{d.name} needs if")
            test = resolve(d.args["if"], given)
            if not isinstance(test, bool):
                raise ValidationError(f"@{d.name}(if:) isn't Boolean")
            if test == (d.name == "skip"):
                return False
    return True


def authorize(directives: list[ast.Directive], given: dict[str, Any], user: str | None, roles: set[str], action: str) -> None:
    """@auth asks for a user; @require(role) and @allow(read, write, role) for one of the roles."""
    for d in directives:
        if d.name not in ("auth", "require", "allow"):
            continue
        if user is None:
            raise Unauthorized(f"@{d.name} needs a user")
        args = resolve(d.args, given)
        wanted = args.get("role") if d.name == "require" else args.get(action, args.get("role")) if d.name == "allow" else None
        if wanted is not None and not roles & set(wanted if isinstance(wanted, list) else [wanted]):
            raise Forbidden(f"needs the role {wanted}")


def flatten(selections: list, fragments: dict[str, ast.Fragment], given: dict[str, Any], on: str | None, known: Callable[[str], bool], path: tuple[str, ...] = ()) -> list[ast.Field]:
    """The fields of a selection set: fragments inlined, @include and @skip applied, variables replaced.

    on: the collection whose fields these are, None where there is none; a fragment
    on another collection adds nothing.
    """
    out: list[ast.Field] = []
    for s in selections:
        if not included(s.directives, given):
            continue
        if isinstance(s, (ast.Spread, ast.Inline)):
            if isinstance(s, ast.Spread):
                if s.name in path:
                    raise ValidationError(f"fragment {s.name} contains itself")
                if s.name not in fragments:
                    raise ValidationError(f"fragment {s.name} isn't defined")
                f, deeper = fragments[s.name], (*path, s.name)
            else:
                f, deeper = s, path
            if not known(f.on):
                raise ValidationError(f"fragment on {f.on}, which is no collection")
            if on is None or f.on == on:
                out += flatten(f.selections, fragments, given, on, known, deeper)
            else:
                flatten(f.selections, fragments, given, f.on, known, deeper)
            continue
        out.append(replace(s, args=resolve(s.args, given), expr=resolve_expression(s.expr, given) if s.expr is not None else None))
    return out


def check_fragments(document: ast.Document, known: Callable[[str], bool]) -> None:
    """Fragments that contain themselves or lie on no collection are errors even if unused."""
    for f in document.fragments.values():
        if not known(f.on):
            raise ValidationError(f"fragment {f.name} on {f.on}, which is no collection")
        _cycle(f.name, document.fragments, ())


def _cycle(name: str, fragments: dict[str, ast.Fragment], path: tuple[str, ...]) -> None:
    if name in path:
        raise ValidationError(f"fragment {name} contains itself")
    if name in fragments:
        _cycle_in(fragments[name].selections, fragments, (*path, name))


def _cycle_in(selections: list, fragments: dict[str, ast.Fragment], path: tuple[str, ...]) -> None:
    for s in selections:
        if isinstance(s, ast.Spread):
            _cycle(s.name, fragments, path)
        elif s.selections:
            _cycle_in(s.selections, fragments, path)
