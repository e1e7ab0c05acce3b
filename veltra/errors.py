"""Errors of the engine; each message says which part refused."""


class EngineError(ValueError):
    prefix = "Engine Error"

    def __init__(self, message: str):
        super().__init__(f"{self.prefix}: {message}")


class TokenizerError(EngineError):
    prefix = "Tokenizer Error"


class ParserError(EngineError):
    prefix = "Parser Error"


class PlannerError(EngineError):
    prefix = "Planner Error"


class CatalogError(EngineError):
    prefix = "Catalog Error"
