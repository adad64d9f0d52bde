"""Reader settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class ReaderConfig:
    host: str = "localhost"
    port: int = 5432
    user: str = "postgres"
    password: str = ""
    database: str = "postgres"
    slot: str = "deltaview"
    publication: str = "deltaview"

    @staticmethod
    def from_env(env: Mapping[str, str] = os.environ, prefix: str = "DELTAVIEW_") -> ReaderConfig:
        own = ReaderConfig()
        found = {f.name: type(getattr(own, f.name))(env[prefix + f.name.upper()]) for f in fields(own) if prefix + f.name.upper() in env}
        return replace(own, **found)

    def jdbc_url(self) -> str:
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.database}"
