"""Typed errors. Each carries a status code and renders as a response document."""

from __future__ import annotations

import json

# Message texts, with {} for the name concerned.
MISSING_PARAM = "Missing {} parameter"
INVALID_IDENTIFIER = "Invalid DDL identifier {}"
NO_SCRIPT = "Either execute or file parameter required"
MISSING_FILE = "File {} does not exist."
MISSING_TABLE = "Table {} does not exist"
MISSING_COLUMN = "unable to find column {}"
PARTITION_EXISTS = "Partition already exists"
INVALID_JOB_ID = "Invalid jobid: {}"
MISSING_JOB = "Could not find job {}"
NOT_COMPLETE = "Job not yet complete"
CALLBACK_RUN = "Callback already run"
NO_CALLBACK = "No callback registered"
# Texts of this package.
TABLE_EXISTS = "Table {} already exists"
COLUMN_EXISTS = "Column {} already exists"
MISSING_PARTITION = "Partition {} does not exist"
NOT_PARTITIONED = "Table {} is not a partitioned table"


class JobError(Exception):
    """Base of every error raised by this package."""

    code = 500

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.message = message
        self.details = details

    def document(self) -> str:
        """The error as a JSON response document."""
        body = {"error": self.message, "errorCode": self.code, **self.details}
        return json.dumps({k: v for k, v in body.items() if v is not None})


class BadParam(JobError):
    """A missing or malformed argument."""

    code = 400


class NotFound(JobError):
    """A table, partition, column or input file that is not there."""

    code = 404


class AlreadyExists(JobError):
    """A table, partition or column that is there already."""

    code = 409


class StatementFailed(JobError):
    """An SQL statement that failed; ``details['statement']`` is its text."""
