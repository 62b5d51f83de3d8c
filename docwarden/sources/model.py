"""A language model behind an HTTP interface: probes, and a client that travels to the tasks."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

PROBE_SECONDS, CALL_SECONDS = 3.0, 60.0


class ModelError(Exception):
    """A call that gave no answer."""


def _json(url: str, body: dict | None, seconds: float) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=seconds) as got:
        return json.load(got)


def names_at(host: str, seconds: float = PROBE_SECONDS) -> list[str] | None:
    """Names of the models that a service offers; none if it can't be reached."""
    try:
        return [str(m.get("name", "")) for m in _json(f"{host}/api/tags", None, seconds).get("models", [])]
    except (OSError, ValueError, AttributeError):
        return None


def reachable(host: str, seconds: float = PROBE_SECONDS) -> bool:
    return names_at(host, seconds) is not None


def available(name: str, host: str, seconds: float = PROBE_SECONDS) -> bool:
    """Whether the service has a model of this name, or of its family, which is the part before the colon."""
    found = names_at(host, seconds) or []
    return name in found or name.split(":")[0] in {x.split(":")[0] for x in found}


@dataclass(frozen=True)
class Model:
    """Answers a prompt at temperature 0. Each task calls the service itself."""

    name: str
    host: str
    seconds: float = CALL_SECONDS

    def __call__(self, prompt: str) -> str:
        try:
            got = _json(f"{self.host}/api/generate", {"model": self.name, "prompt": prompt, "stream": False, "options": {"temperature": 0.0}}, self.seconds)
            return str(got.get("response", ""))
        except (OSError, ValueError, AttributeError) as e:
            raise ModelError(f"{self.name} at {self.host}: {e}") from e
