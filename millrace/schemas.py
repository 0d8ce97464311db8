"""Record layouts as DDL text, usable by from_json, createDataFrame and cast alike."""

DATA_REF = "struct<ref_type:string,location:string,format:string,metadata:map<string,string>>"
EXECUTION = "struct<execution_type:string,details:map<string,string>>"

JOB = f"""job_id string, pipeline string, environment string, namespace string, status string,
    logic_version string, request map<string,string>, parameters map<string,string>,
    dag_run_id string, created_at timestamp, started_at timestamp, completed_at timestamp,
    error string, metadata map<string,string>"""

STEP = f"""step_id string, job_id string, step_name string, handler_type string, action string,
    status string, correlation_id string, inputs array<{DATA_REF}>, outputs array<{DATA_REF}>,
    executions array<{EXECUTION}>, started_at timestamp, completed_at timestamp,
    duration_ms int, error string, metadata map<string,string>"""

ASSET = """name string, asset_type string, location string, description string,
    columns array<struct<name:string,type:string>>, tags array<string>, upstream array<string>,
    downstream array<string>, created_by string, metadata map<string,string>"""

COMMAND_MESSAGE = """type string, action string, payload map<string,string>, correlation_id string,
    job_id string, step_id string, metadata map<string,string>, timestamp string"""

RESULT_MESSAGE = f"""status string, data map<string,string>, errors array<string>,
    correlation_id string, job_id string, step_id string, duration_ms int, timestamp string,
    handler string, inputs array<{DATA_REF}>, outputs array<{DATA_REF}>,
    executions array<{EXECUTION}>"""

EVENT_MESSAGE = """type string, payload map<string,string>, correlation_id string,
    timestamp string, source string"""

# The status words of each record kind.
STEP_STATUSES = ("pending", "running", "success", "failed", "skipped")
RESULT_STATUSES = ("success", "error", "pending")
JOB_TERMINAL = ("success", "failed", "cancelled")
STEP_TERMINAL = ("success", "failed", "skipped")
