"""Configuration: given value, then specific variable, then general one, then default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

PREFIX = "ESTANTE_"
#: Flags of the command line that a resumed run takes over, and their names in the saved parameters; keys are never stored.
SAVED_FLAGS = {"origem": "origem", "destino": "destino", "dry_run": "dry_run", "recursive": "recursive", "mover": "mover", "subpasta_md": "subpasta_markdown", "modelo": "modelo", "ollama_url": "ollama_url", "provedor": "provedor", "provedor_fallback": "provedor_fallback", "modelo_fallback": "modelo_fallback"}
#: How providers are shown to people.
DISPLAY = {"ollama": "Ollama (local)", "anthropic": "Anthropic", "openai": "OpenAI", "gemini": "Gemini", "deepseek": "DeepSeek", "grok": "Grok"}
# Providers with their address, and words read as yes and no.
PROVIDERS = {"ollama": "http://localhost:11434", "anthropic": "https://api.anthropic.com", "openai": "https://api.openai.com/v1", "gemini": "https://generativelanguage.googleapis.com/v1beta/openai", "deepseek": "https://api.deepseek.com", "grok": "https://api.x.ai/v1"}
YES, NO = {"1", "true", "sim", "on", "verdadeiro"}, {"0", "false", "nao", "não", "off", "falso"}


def parse_bool(text: str | None, default: bool) -> bool:
    word = (text or "").strip().lower()
    if not word:
        return default
    if word in YES | NO:
        return word in YES
    raise ValueError(f"valor booleano inválido: {text}")


def parse_positive(text: str | int | None, default: int) -> int:
    if text is None or str(text).strip() == "":
        return default
    if not str(text).strip().isdigit() or int(text) < 1:
        raise ValueError(f"inteiro positivo esperado: {text}")
    return int(text)


def _variables(path: str) -> dict[str, str]:
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().removeprefix("export ").split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def dotenv(place: str) -> dict[str, str]:
    """Variables of the named file, or of the nearest .env at or above a folder; later the process's own go before them."""
    folder = os.path.abspath(place)
    if os.path.isfile(folder):
        return _variables(folder)
    while True:
        path = os.path.join(folder, ".env")
        if os.path.isfile(path):
            return _variables(path)
        if os.path.dirname(folder) == folder:
            return {}
        folder = os.path.dirname(folder)


@dataclass(frozen=True)
class Config:
    provider: str
    model: str
    api_key: str | None
    base_url: str
    fallback: str | None = None
    fallback_model: str | None = None
    fallback_key: str | None = None
    pages: int = 6
    characters: int = 15_000
    verify_online: bool = True

    @classmethod
    def resolve(cls, env: Mapping[str, str], **given) -> Config:
        """given: provider, model, api_key, base_url, fallback, fallback_model, fallback_key, pages, characters; None is not given."""
        of = lambda name, var, default=None: given.get(name) or env.get(PREFIX + var) or default

        def checked(provider: str) -> str:
            if provider not in PROVIDERS:
                raise ValueError(f"provedor desconhecido: {provider}")
            return provider

        def model(provider: str, name: str, var: str) -> str:
            found = of(name, var, "qwen2.5:3b" if provider == "ollama" else None)
            if not found:
                raise ValueError(f"{provider} exige um modelo")
            return found

        def key(provider: str, name: str) -> str | None:
            found = given.get(name) or env.get(f"{PREFIX}{provider.upper()}_API_KEY") or env.get(PREFIX + "API_KEY")
            if provider != "ollama" and not found:
                raise ValueError(f"{provider} exige uma chave")
            return None if provider == "ollama" else found

        first = checked(of("provider", "PROVEDOR", "ollama"))
        second = of("fallback", "PROVEDOR_FALLBACK")
        return cls(
            first, model(first, "model", "MODELO"), key(first, "api_key"), of("base_url", "OLLAMA_URL", PROVIDERS[first]) if first == "ollama" else PROVIDERS[first],
            checked(second) if second else None, model(second, "fallback_model", "MODELO_FALLBACK") if second else None, key(second, "fallback_key") if second else None,
            parse_positive(of("pages", "MAX_PAGINAS"), 6), parse_positive(of("characters", "MAX_CARACTERES"), 15_000), parse_bool(env.get(PREFIX + "VERIFICAR_ONLINE"), True),
        )
