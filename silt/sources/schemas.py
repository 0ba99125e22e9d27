"""Schemas of host metrics and sensor rows, and their JSON rows as typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column names and types, unsigned 64-bit numbers as decimal(20,0), smaller unsigned ones a size up.
HOST_METRICS = """
timestamp_unix_nano u64, sensor_name string, sensor_target_platform string, sensor_host_platform string, event_family string,
event_kind string, signal_family string, signal_status string, control_generation u64, control_source string,
control_path string, enabled_families string, effective_emit_signal_rows boolean, message string, process_pid bigint,
process_parent_pid bigint, process_name string, process_cmd string, process_exe string, process_status string,
process_cpu_usage float, process_memory_bytes u64, process_virtual_memory_bytes u64, process_start_time_unix_sec u64,
process_disk_read_delta_bytes u64, process_disk_write_delta_bytes u64, process_user_id bigint,
process_effective_user_id bigint, process_group_id bigint, process_effective_group_id bigint, process_cwd string,
process_session_id bigint, process_run_time_secs u64, process_open_files u64, process_thread_count u64,
process_container_id string, network_interface string, network_received_delta_bytes u64,
network_transmitted_delta_bytes u64, network_received_total_bytes u64, network_transmitted_total_bytes u64,
network_packets_received_delta u64, network_packets_transmitted_delta u64, network_errors_received_delta u64,
network_errors_transmitted_delta u64, network_mac_address string, network_ip_addresses string, network_mtu u64,
system_total_memory_bytes u64, system_used_memory_bytes u64, system_available_memory_bytes u64,
system_total_swap_bytes u64, system_used_swap_bytes u64, system_cpu_usage_percent float, system_uptime_secs u64,
system_cgroup_memory_limit u64, system_cgroup_memory_current u64, disk_io_read_delta_bytes u64,
disk_io_write_delta_bytes u64, disk_io_read_total_bytes u64, disk_io_write_total_bytes u64
"""
PLATFORM_SENSOR = """
timestamp_unix_nano u64, event_kind string, tgid bigint, pid bigint, ppid bigint, uid bigint, gid bigint, cgroup_id u64,
comm string, filename string, exit_code int, flags bigint, old_path string, new_path string, target_uid bigint,
target_gid bigint, module_taints bigint, ptrace_request string, ptrace_target_pid u64, src_addr string, dst_addr string,
src_port int, dst_port int, dns_qname string, dns_qtype int, dns_tx_id int
"""


def schema(columns: str) -> StructType:
    return StructType.fromDDL(columns.replace(" u64", " decimal(20,0)").strip())


def of(kind: str) -> StructType:
    """The schema of an input's rows."""
    return schema(HOST_METRICS if kind in ("host_metrics", "macos_es_sensor", "windows_ebpf_sensor") else PLATFORM_SENSOR)


def typed_rows(lines: DataFrame, columns: str) -> DataFrame:
    """JSON lines (value) as rows of a schema; missing fields are null."""
    return lines.select(F.from_json("value", schema(columns)).alias("r")).select("r.*")


def matching(rows: DataFrame, column: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Rows whose column matches a glob of include (if there are any) and none of exclude."""

    def like(glob: str):
        text = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
        return F.coalesce(F.col(column).like(text), F.lit(False))

    for glob in exclude:
        rows = rows.where(~like(glob))
    if include:
        hit = like(include[0])
        for glob in include[1:]:
            hit |= like(glob)
        rows = rows.where(hit)
    return rows
