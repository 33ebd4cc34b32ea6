"""Settings: defaults, then a TOML file, then flags; a key in the environment comes last."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass
from pathlib import Path

#: Defaults that an API key in the environment moves to the hosted service (fixed values).
LOCAL_URL, HOSTED_URL = "http://localhost:11434/v1", "https://api.openai.com/v1"
LOCAL_CHAT, HOSTED_CHAT = "llama3.2", "gpt-5"


@dataclass(frozen=True)
class Config:
    base_url: str = LOCAL_URL
    api_key: str = "ollama"
    chat_model: str = LOCAL_CHAT
    embed_model: str = "nomic-embed-text"
    workspace: str = ""
    search_results: int = 5
    semantic_weight: float = 0.7
    lexical_weight: float = 0.3
    retrieval_candidates: int = 10
    retrieval_limit: int = 3
    retrieval_threshold: float = 0.5
    flush_every: int = 10
    decay_half_life_days: float = 30.0
    debug: bool = False

    def __post_init__(self):
        if not self.decay_half_life_days > 0:
            raise ValueError("decay_half_life_days must be positive")


def parse_env(text: str) -> dict[str, str]:
    """Assignments of an .env file: comments and blank lines are skipped, ``export`` and quotes dropped."""
    found = {}
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#") and "=" in line:
            name, _, value = line.removeprefix("export ").partition("=")
            found[name.strip()] = value.strip().strip('"').strip("'")
    return found


def load(flags: dict | None = None, config_path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """Settings by precedence. A missing file is ignored, a malformed one is an error; unknown names in it are ignored."""
    env = dict(os.environ if env is None else env)
    if env is not None and Path(".env").exists():
        env |= parse_env(Path(".env").read_text())
    home = env.get("HOME", ".")
    values: dict = {"workspace": str(Path(home) / ".lanternbase")}
    path = Path(config_path) if config_path else Path(home) / ".config" / "lanternbase" / "config.toml"
    names = {f.name for f in dataclasses.fields(Config)} - {"debug"}
    if path.exists():
        values |= {k: v for k, v in tomllib.loads(path.read_text()).items() if k in names}
    values |= {k: v for k, v in (flags or {}).items() if v is not None and k in names | {"debug"}}
    if key := env.get("OPENAI_API_KEY"):
        values["api_key"] = key
        for name, default, hosted in (("base_url", LOCAL_URL, HOSTED_URL), ("chat_model", LOCAL_CHAT, HOSTED_CHAT)):
            if values.get(name, default) == default:
                values[name] = hosted
    return Config(**values)
