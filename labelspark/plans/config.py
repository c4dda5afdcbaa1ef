"""Configuration of an evaluation run."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.functions.text import slug_text

OPTIONS_TYPE = (
    "struct<max_tokens:int,temperature:double,top_p:double,reasoning_effort:string,thinking_tokens:int>"
)
CONFIG_TYPE = (
    "struct<technique_name:string,max_tokens:int,prompt:string,prompt_role:string,temperature:double,"
    "top_p:double,reasoning_effort:string,thinking_tokens:int,out_path:string>"
)
# Field names of older configurations.
RENAMED_FIELDS = {"name": "technique_name", "claude_thinking_tokens": "thinking_tokens"}
EFFORTS = (None, "low", "medium", "high")


@dataclass(frozen=True)
class RunConfig:
    """How a model is asked: technique name, prompt, token budget and sampling options."""

    technique_name: str
    max_tokens: int
    prompt: str | None = None
    prompt_role: str = "system"
    temperature: float = 0.0
    top_p: float | None = None
    reasoning_effort: str | None = None
    thinking_tokens: int | None = None
    out_path: str = "results"

    def __post_init__(self):
        if self.reasoning_effort not in EFFORTS:
            raise ValueError("reasoning_effort must be low, medium or high")
        object.__setattr__(self, "temperature", float(self.temperature))
        if self.top_p is not None:
            object.__setattr__(self, "top_p", float(self.top_p))

    @property
    def run_id(self) -> str:
        """File-safe technique name; also the folder of the run."""
        return slug_text(self.technique_name)

    @classmethod
    def from_dict(cls, data: dict) -> RunConfig:
        """From a dictionary; names of older versions are understood, other fields ignored."""
        data = {RENAMED_FIELDS.get(k, k): v for k, v in data.items()}
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})

    @classmethod
    def from_json(cls, text: str) -> RunConfig:
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, indent=4)

    def as_column(self) -> Column:
        """The configuration as a struct literal."""
        options = F.struct(
            F.lit(self.max_tokens), F.lit(self.temperature), F.lit(self.top_p),
            F.lit(self.reasoning_effort), F.lit(self.thinking_tokens),
        ).cast(OPTIONS_TYPE)
        return F.struct(
            F.lit(self.run_id).alias("run_id"),
            F.lit(self.prompt).cast("string").alias("prompt"),
            F.lit(self.prompt_role).alias("prompt_role"),
            options.alias("options"),
        )
