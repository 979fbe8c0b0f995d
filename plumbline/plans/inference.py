"""Settings that turn videos into predictions: one table of them, presets, which source wins, requests, and a run's metadata."""

from __future__ import annotations

import copy
import hashlib
import importlib
import json
import platform
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from plumbline.functions.parsing import FORMATS, SCOPES, STYLES
from plumbline.taxonomy import RESOURCES, Taxonomy, load_taxonomy

FORMAT = "inference_config/v1"
FILE_NAME = "inference_config.json"
VIDEO = "<video>"
POSITIONS = ("after", "before", "placeholder")


class InferenceError(ValueError):
    """Settings that contradict each other, are unknown, or can't be found."""


def _above(least: float) -> Callable[[Any], bool]:
    return lambda v: v > least


def _one_of(*values: str) -> Callable[[Any], bool]:
    return lambda v: v in values


def _any(_: Any) -> bool:
    return True


#: Settings by section: default and test of each. A section of None is no section but a setting itself.
SETTINGS: dict[str, dict[str, tuple[Any, Callable[[Any], bool]]]] = {
    "video": {
        "fps": (1.0, _above(0)),
        "min_pixels": (12544, _above(0)),
        "max_pixels": (200704, _above(0)),
        "image_patch_size": (14, _above(0)),
        "position": ("after", _one_of(*POSITIONS)),
    },
    "parser": {"output_style": ("json", _one_of(*STYLES)), "scope": ("full_response", _one_of(*SCOPES)), "require_block_prefix": (True, _any)},
    "generation": {
        "max_new_tokens": (1024, _above(0)),
        "temperature": (0.0, lambda v: v >= 0),
        "top_p": (1.0, _any),
        "top_k": (-1, _any),
        "repetition_penalty": (1.0, _any),
        "seed": (None, _any),
    },
    "processor": {"source": ("checkpoint", _any), "revision": (None, _any), "use_fast": (False, _any)},
}
PLAIN: dict[str, Any] = {"system_prompt": None, "base_model": None, "max_model_len": None, "preset": None, "description": None, "provenance": {}}
#: What tells no two sets of settings apart.
NOTES = ("description", "provenance")


@dataclass(frozen=True)
class InferenceConfig:
    """Checked settings: a label space, the exact prompt, a response format, and ``values`` by section."""

    taxonomy: Taxonomy
    prompt: str
    response_format: str
    values: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        merged = copy.deepcopy(PLAIN) | {k: v for k, v in self.values.items() if k in PLAIN}
        for section, table in SETTINGS.items():
            given = self.values.get(section) or {}
            if not isinstance(given, Mapping) or set(given) - set(table):
                raise InferenceError(f"invalid {section} settings: {given!r}")
            merged[section] = {k: given.get(k, default) for k, (default, _) in table.items()}
            for k, (_, good) in table.items():
                if not good(merged[section][k]):
                    raise InferenceError(f"{section}.{k} can't be {merged[section][k]!r}")
        if strange := sorted(set(self.values) - set(SETTINGS) - set(PLAIN)):
            raise InferenceError(f"unknown settings {strange}")
        object.__setattr__(self, "values", merged)
        if self.response_format not in FORMATS:
            raise InferenceError(f"response_format is one of {', '.join(FORMATS)}")
        video = merged["video"]
        if video["min_pixels"] > video["max_pixels"]:
            raise InferenceError("video.min_pixels is at most video.max_pixels")
        if not self.prompt:
            raise InferenceError("the prompt is empty")
        if self.prompt.count(VIDEO) != (video["position"] == "placeholder"):
            raise InferenceError(f"a prompt holds {VIDEO!r} once where video.position is 'placeholder', and else not at all")

    def __getitem__(self, dotted: str) -> Any:
        value: Any = self.values
        for part in dotted.split("."):
            value = value[part]
        return value

    def to_dict(self) -> dict[str, Any]:
        prompt = {"text": self.prompt, "sha256": hashlib.sha256(self.prompt.encode()).hexdigest()}
        label_space = {"taxonomy": self.taxonomy.to_dict(), "taxonomy_fingerprint": self.taxonomy.fingerprint()}
        return {"format": FORMAT, **label_space, "prompt": prompt, "response_format": self.response_format, **copy.deepcopy(self.values)}

    def fingerprint(self) -> str:
        """SHA-256 of everything but notes."""
        kept = {k: v for k, v in self.to_dict().items() if k not in NOTES}
        return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    @classmethod
    def from_dict(cls, document: Mapping[str, Any]) -> InferenceConfig:
        """From a document, whose recorded hashes must hold."""
        rest = copy.deepcopy(dict(document))
        if (kind := rest.pop("format", FORMAT)) != FORMAT:
            raise InferenceError(f"unknown format {kind!r}")
        try:
            taxonomy, prompt, response_format = load_taxonomy(rest.pop("taxonomy")), rest.pop("prompt"), rest.pop("response_format")
        except KeyError as e:
            raise InferenceError(f"{e.args[0]} is missing") from e
        pinned = {"taxonomy_fingerprint": (rest.pop("taxonomy_fingerprint", None), taxonomy.fingerprint())}
        if isinstance(prompt, Mapping):
            pinned["prompt.sha256"] = prompt.get("sha256"), hashlib.sha256(prompt["text"].encode()).hexdigest()
            prompt = prompt["text"]
        for name, (recorded, found) in pinned.items():
            if recorded not in (None, found):
                raise InferenceError(f"{name} is {found}, not the recorded {recorded}")
        if isinstance(rest.get("processor"), str):
            rest["processor"] = {"source": rest["processor"]}
        return cls(taxonomy, prompt, response_format, rest)

    @classmethod
    def from_file(cls, path: str | Path) -> InferenceConfig:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    def save(self, path: str | Path) -> Path:
        target = Path(path) / FILE_NAME if Path(path).is_dir() else Path(path)
        target.write_text(json.dumps(self.to_dict(), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
        return target

    def with_overrides(self, overrides: Mapping[str, Any]) -> InferenceConfig:
        """The settings with some replaced by dotted name; each must be there."""
        document = self.to_dict() | {"prompt": self.prompt}
        del document["taxonomy_fingerprint"]
        for name, value in overrides.items():
            *sections, last = name.split(".")
            place: Any = document
            for part in sections:
                place = place.get(part) if isinstance(place, Mapping) else None
            if not isinstance(place, Mapping) or last not in place:
                raise InferenceError(f"unknown setting {name!r}")
            place[last] = value
        return InferenceConfig.from_dict(document)


# presets


def _presets(folder: Path) -> dict[str, dict[str, Any]]:
    import yaml

    return {p.stem: yaml.safe_load(p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.yaml"))}


def list_presets(folder: str | Path = RESOURCES / "presets") -> dict[str, str]:
    """Descriptions by name."""
    return {name: " ".join(str(p.get("description") or "").split()) for name, p in _presets(Path(folder)).items()}


def load_preset(name: str, folder: str | Path = RESOURCES / "presets") -> InferenceConfig:
    """A preset's settings. Its prompt is rendered from the label space, or a file whose hash it pins."""
    from plumbline.plans.prompts import apply_format_template, resolve_prompt

    found = _presets(Path(folder))
    if name not in found:
        raise InferenceError(f"no preset {name!r}; there are {', '.join(found) or 'none'}")
    preset = dict(found[name])
    if preset.pop("name", name) != name:
        raise InferenceError(f"the file of preset {name!r} holds another one")
    taxonomy = load_taxonomy(preset["taxonomy"])
    text, source = resolve_prompt(preset.pop("prompt"), taxonomy, Path(folder))
    if source.get("render"):
        text = apply_format_template(text, preset["response_format"])
    provenance = dict(preset.pop("provenance", None) or {}) | {"prompt": source}
    return InferenceConfig.from_dict(preset | {"preset": name, "prompt": text, "provenance": provenance})


def resolve_settings(model: str, preset: str | None = None, config: Any = None, overrides: Mapping[str, Any] | None = None, fallback: str | None = None, presets: str | Path = RESOURCES / "presets") -> tuple[InferenceConfig, dict[str, Any]]:
    """Settings for a model and where they come from: those given, else a preset, else the file beside the model, else a
    fallback preset; overrides come last."""
    if config is not None and preset is not None:
        raise InferenceError("give a config or a preset, not both")
    beside = Path(model) / FILE_NAME
    own = InferenceConfig.from_file(beside) if beside.is_file() else None

    def given() -> InferenceConfig:
        if isinstance(config, InferenceConfig):
            return config
        return InferenceConfig.from_dict(config) if isinstance(config, Mapping) else InferenceConfig.from_file(config)

    sources: tuple[tuple[str, bool, Callable[[], InferenceConfig]], ...] = (
        ("config", config is not None, given),
        (f"preset:{preset}", preset is not None, lambda: load_preset(preset, presets)),
        ("model", own is not None, lambda: own),
        (f"fallback:{fallback}", fallback is not None, lambda: load_preset(fallback, presets)),
    )
    name, found = next(((name, make()) for name, there, make in sources if there), (None, None))
    if found is None:
        raise InferenceError(f"{model} has no {FILE_NAME}; give a preset or a config")
    info: dict[str, Any] = {"source": name}
    if own is not None and name != "model":
        info["model_settings_overridden"] = own.fingerprint() != found.fingerprint()
        if info["model_settings_overridden"]:
            warnings.warn(f"the model's {FILE_NAME} differs from {name}, which is used", stacklevel=2)
    if overrides:
        found, info["overrides"] = found.with_overrides(overrides), dict(overrides)
    return found, info


# requests


def build_messages(config: InferenceConfig, video: str) -> list[dict[str, Any]]:
    """The chat messages of one video: it stands after or before the prompt, or in its place inside it."""
    clip = {"type": "video", "video": video, **{k: config[f"video.{k}"] for k in ("max_pixels", "fps", "min_pixels")}}
    says = lambda text: [{"type": "text", "text": text}] if text else []
    before, _, after = config.prompt.partition(VIDEO)
    content = {
        "after": [*says(config.prompt), clip],
        "before": [clip, *says(config.prompt)],
        "placeholder": [*says(before), clip, *says(after)],
    }[config["video.position"]]
    system = config["system_prompt"]
    return [*([{"role": "system", "content": system}] if system is not None else []), {"role": "user", "content": content}]


# metadata of a run

LIBRARIES = ("pyspark", "pyarrow", "pandas", "numpy", "torch", "transformers", "vllm", "av", "decord", "torchvision")


def library_versions() -> dict[str, str | None]:
    """Versions of Python and of libraries that may be there."""
    found: dict[str, str | None] = {"python": platform.python_version()}
    for name in LIBRARIES:
        try:
            found[name] = getattr(importlib.import_module(name), "__version__", "unknown")
        except ImportError:
            found[name] = None
    return found


def run_metadata(config: InferenceConfig | None = None) -> dict[str, Any]:
    """What a run's predictions depend on besides their inputs."""
    out: dict[str, Any] = {"versions": library_versions(), "hardware": {"platform": platform.platform()}}
    if config is not None:
        out |= {"config": config.to_dict(), "config_fingerprint": config.fingerprint()}
    return out
