"""Engine settings from an environment-like mapping, with silent defaults for what cannot be read."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit

# Words that switch a setting on.
TRUE_WORDS = ("1", "true", "yes", "on")


def parse_int(env: Mapping[str, str], name: str, default: int) -> int:
    try:
        return int(env.get(name, default))
    except ValueError:
        return default


def parse_float(env: Mapping[str, str], name: str, default: float) -> float:
    try:
        return float(env.get(name, default))
    except ValueError:
        return default


def parse_bool(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    text = env.get(name)
    return default if text is None else text.strip().lower() in TRUE_WORDS


def parse_mapping(env: Mapping[str, str], name: str) -> dict[str, str]:
    """A JSON object's truthy members; anything else is empty."""
    try:
        found = json.loads(env.get(name) or "{}")
    except ValueError:
        return {}
    return {str(k): str(v) for k, v in found.items() if v} if isinstance(found, dict) else {}


@dataclass(frozen=True)
class Settings:
    ocr_language: str = "eng"
    ocr_tenant_languages: dict[str, str] = field(default_factory=dict)
    ocr_timeout_seconds: float = 30.0
    ocr_max_pages: int = 20
    deskew: bool = False
    binarization: bool = False
    contrast_enhancement: bool = False
    review_below: float = 0.8
    attempts: int = 3
    base_delay_seconds: float = 1.0
    upload_retries: int = 3
    upload_timeout_seconds: float = 15.0


def load(env: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env
    d = Settings()
    return Settings(
        env.get("OCR_LANGUAGE") or d.ocr_language, parse_mapping(env, "OCR_TENANT_LANGUAGES"), max(
            0.0, parse_float(env, "OCR_TIMEOUT_SECONDS", d.ocr_timeout_seconds),
        ), max(1, parse_int(env, "OCR_MAX_PAGES", d.ocr_max_pages)),
        parse_bool(env, "OCR_DESKEW"), parse_bool(env, "OCR_BINARIZATION"), parse_bool(env, "OCR_CONTRAST_ENHANCEMENT"), parse_float(env, "REVIEW_BELOW", d.review_below), parse_int(env, "EXTRACT_RETRY_ATTEMPTS", d.attempts),
        parse_float(
            env, "EXTRACT_RETRY_BASE_DELAY_SECONDS", d.base_delay_seconds,
        ), parse_int(env, "UPLOAD_RETRIES", d.upload_retries), parse_float(env, "UPLOAD_TIMEOUT_SECONDS", d.upload_timeout_seconds),
    )


def endpoint(url: str) -> str:
    """The accounting server's address: the url's host and port (443 for https, else 9000), always http."""
    parts = urlsplit(url)
    return f"http://{parts.hostname or 'localhost'}:{parts.port or (443 if parts.scheme == 'https' else 9000)}"
