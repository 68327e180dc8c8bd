"""Settings: nested sections with defaults, read from a mapping or YAML, changed by dotted names."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class Clean:
    max_words: int = 256
    min_chars: int = 20
    max_chars: int = 1000
    language: str = "kaz"


@dataclass
class Encode:
    max_tokens: int = 256
    vocabulary: int = 32_000
    tokenizer: str | None = None


@dataclass
class Batch:
    size: int = 48
    bucket: int = 2048
    drop_last: bool = True
    seed: int = 42


@dataclass
class Settings:
    clean: Clean = field(default_factory=Clean)
    encode: Encode = field(default_factory=Encode)
    batch: Batch = field(default_factory=Batch)


def coerced(text: str, now):
    """A text as the type of the present value; ``null`` where there is none yet or to unset it."""
    if text.lower() in ("null", "none", ""):
        return None
    if isinstance(now, bool):
        if text.lower() in ("true", "1", "yes"):
            return True
        if text.lower() in ("false", "0", "no"):
            return False
        raise ValueError(f"{text!r} is no truth value")
    for kind in (int, float):
        if isinstance(now, kind):
            return kind(text)
    return text


def _fill(target, values: dict, path: str = "") -> None:
    known = {f.name for f in fields(target)}
    for k, v in values.items():
        if k not in known:
            raise KeyError(f"unknown setting {path}{k}")
        now = getattr(target, k)
        if is_dataclass(now):
            if not isinstance(v, dict):
                raise TypeError(f"{path}{k} is a section")
            _fill(now, v, f"{path}{k}.")
        else:
            setattr(target, k, v)


def load(values: dict | str | None = None, overrides: list[str] = ()) -> Settings:
    """Settings of a mapping or a YAML file, then overrides ``section.name=value``."""
    if isinstance(values, str):
        import yaml

        with open(values, encoding="utf-8") as f:
            values = yaml.safe_load(f)
    s = Settings()
    _fill(s, values or {})
    for o in overrides:
        name, sign, text = o.partition("=")
        *path, last = name.split(".")
        at = s
        for p in path:
            at = getattr(at, p, None)
        if not sign or not is_dataclass(at) or last not in {f.name for f in fields(at)} or is_dataclass(getattr(at, last)):
            raise KeyError(f"unknown setting {o}")
        setattr(at, last, coerced(text, getattr(at, last)))
    return s
