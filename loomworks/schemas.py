"""Explicit schemas of the engine's inputs; JSON sources are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


JOBS = _struct(id=_S, pipeline_id=_S, status=_S, created_at=_S, started_at=_S, completed_at=_S, data=_S, result=_S, error=_S, git=_S)
ERROR = _struct(message=_S, stack=_S, code=_S, cancelled=_B)
GIT = _struct(branchName=_S, originalBranch=_S, commitSha=_S, prUrl=_S, changedFiles=T.ArrayType(_S))
PATTERN_MATCH = _struct(file_path=_S, rule_id=_S, matched_text=_S, line_start=_I, line_end=_I, column_start=_I, column_end=_I, severity=_S, confidence=_D)
REPOSITORY_INFO = _struct(path=_S, name=_S, git_remote=_S, git_branch=_S, git_commit=_S)
PIPELINE_INPUT = _struct(repository_info=REPOSITORY_INFO, total_repo_lines=_L, pattern_matches=T.ArrayType(PATTERN_MATCH))
SCAN_HISTORY = _struct(timestamp=_S, status=_S, duration=_D, duplicatesFound=_L)
REPOSITORY = _struct(name=_S, path=_S, priority=_S, scanFrequency=_S, enabled=_B, tags=T.ArrayType(_S), lastScannedAt=_S, scanHistory=T.ArrayType(SCAN_HISTORY))
REPOSITORY_GROUP = _struct(name=_S, repositories=T.ArrayType(_S), enabled=_B)
REPOSITORY_CONFIG = _struct(repositories=T.ArrayType(REPOSITORY), repositoryGroups=T.ArrayType(REPOSITORY_GROUP))
REPORT_SUMMARY = _struct(scanType=_S, repositories=T.ArrayType(_S), totalDuplicates=_L, totalBlocks=_L, scanDuration=_D)
LINT_MESSAGE = _struct(ruleId=_S, message=_S, line=_I, column=_I)
LINT_FILE = _struct(filePath=_S, messages=T.ArrayType(LINT_MESSAGE))
LIFECYCLE_EVENT = _struct(id=_L, timestamp=_S, type=_S, event=_S, message=_S, jobId=_S, jobType=_S, status=_S, duration=_D, attempt=_I, maxAttempts=_I, delay=_L, reason=_S, error=_S)
REPO_STATS = _struct(path=_S, name=_S, parent=_S, commits=_L, monthlyCommits=T.MapType(_S, _L), files=T.ArrayType(_S), additions=_L, deletions=_L)
FILE_LINE = _struct(file_path=_S, line_no=_I, line=_S)
CACHE_ENTRY = _struct(key=_S, repository=_S, commit=_S, cached_at=T.TimestampType(), payload=_S)
