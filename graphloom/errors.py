"""What can be wrong with a query, with advice for each kind of error."""

from __future__ import annotations


class QueryError(Exception):
    """Base of all errors of this engine."""

    advice = ""
    schema = types = reference = False

    def report(self) -> str:
        return f"{self}\n  hint: {self.advice}" if self.advice else str(self)


class ParseError(QueryError):
    advice = "check the syntax near the place that is named"


class FieldNotFound(QueryError):
    advice, schema, reference = "define the field on the table, or correct its name", True, True


class TableNotFound(QueryError):
    advice, schema, reference = "define the table before it is queried", True, True


class ParameterNotFound(QueryError):
    advice, reference = "pass a value for the parameter", True


class FunctionNotFound(QueryError):
    advice, reference = "check the namespace and the name of the function", True


class TypeMismatch(QueryError):
    advice, types = "cast the value, or change the type of the field", True


class SchemaViolation(QueryError):
    advice, schema = "give the field a TYPE", True


class InvalidPath(QueryError):
    advice, reference = "follow only fields, links and edges that are defined", True


class InvalidFunctionCall(QueryError):
    advice, types = "check the number and the types of the arguments", True


class RecordExists(QueryError):
    advice, schema = "use another id, UPSERT, or INSERT IGNORE", True


class PermissionDenied(QueryError):
    advice = "run the query with an account that may"


class UnexpectedSyntax(QueryError):
    advice = "this form is not allowed here"


class MissingAuth(QueryError):
    advice = "set the session's auth record first"


class Unimplemented(QueryError):
    advice = "this statement cannot be run by the engine"


class LanguageNotImplemented(QueryError):
    advice = "choose the TypeScript output"
