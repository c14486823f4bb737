"""Word lists, patterns, thresholds and presets that define the results.

They are stated here in one place because results depend on them literally.
"""

from __future__ import annotations

# Reserved labels for values that are not ordinary categories.
MISSING = "<MISSING>"
RARE = "<RARE>"
OTHER = "<OTHER>"
MISSING_CUSTOMER = "<MISSING_CUSTOMER>"

# Binary label spellings, compared after trim and lower.
BAD_SPELLINGS = ("1", "1.0", "true", "bad", "yes")
GOOD_SPELLINGS = ("0", "0.0", "false", "good", "no")

# Values a binary target candidate may hold, compared after trim and lower.
TARGET_SPELLINGS = ("0", "1", "-1", "0.0", "1.0", "-1.0", "true", "false")

# Column-name rules (case-insensitive).
ID_NAME = r"(^id$|_id$|id_|uuid|订单号|客户号|流水号|主键)"
TIME_NAME = r"((?:^|_)(?:date|time|month|day|datetime|timestamp)(?:$|_)|日期|时间|月份)"
LEAKAGE_NAME = (
    r"(post_|after_|贷后|催收|结清|逾期结果|最终状态|repay|collection|write[_-]?off|charge[_-]?off)"
)
HISTORICAL_RISK_NAME = r"^(prior_|historical_|pre_application_).*(delinquen|overdue|past_due)"
PII_NAME = (
    r"(^|_)(name|mobile|phone|id_?card|identity|email|address|bank_?card"
    r"|姓名|手机号|身份证|邮箱|地址|银行卡)($|_)"
)

# Text rules (case-insensitive).
SECRET_TEXT = (
    r"((?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{12,}|api[_-]?key\s*[:=]|bearer\s+[A-Za-z0-9._-]{12,})"
)
# Three constants, because the scan counts the three kinds separately.
PII_MOBILE = r"\b1[3-9]\d{9}\b"
PII_ID_NUMBER = r"\b\d{15}(?:\d{2}[0-9Xx])?\b"
PII_EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"

# Customer-key preference: tokens that speak for a person, and for a single order.
PERSON_TOKENS = (
    "customer", "cust", "user", "person", "borrower", "client", "客户", "用户", "借款人",
)
ORDER_TOKENS = ("order", "loan", "application", "contract", "订单", "借据", "申请")

# Data-dictionary header aliases, compared after trim and lower.
DICTIONARY_HEADERS = {
    "field": ("field", "column", "name", "字段", "字段名", "变量名"),
    "description": ("description", "desc", "meaning", "含义", "字段含义", "变量含义"),
    "missing_codes": ("missing", "missing_codes", "缺失值", "缺失码"),
    "role": ("role", "字段角色", "用途"),
}
DICTIONARY_CODE_SEPARATOR = r"[,，;；|]"

# Screening reasons a reviewer may override.
RECOVERABLE_REASONS = ("MISSING_RATE", "LOW_IV", "HIGH_CORRELATION", "UNSUPPORTED_TYPE")

# Groups smaller than this never leave with more than their count.
MIN_GROUP_COUNT = 30

# Fields that must agree before two runs may be compared.
MANIFEST_FIELDS = (
    "git_sha",
    "source_tree_sha256",
    "runtime_binary_sha256",
    "agent_graph_version",
    "tool_manifest_hash",
    "policy_hash",
    "prompt_manifest.manifest_sha256",
    "dataset.content_sha256",
    "provider.name",
    "provider.api_format",
    "provider.endpoint_sha256",
    "provider.llm_enabled",
    "provider.model",
    "provider.reviewer_model",
    "provider.parameters",
    "environment.python",
    "environment.os",
    "eval_suite.suite_version",
    "eval_suite.evaluator_version",
    "eval_suite.case_config_sha256",
)

# Encodings tried in this order for a CSV file; the last one always decodes.
CSV_ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5")
CSV_FALLBACK_ENCODING = "latin1"
CSV_DELIMITERS = ",\t;|"
