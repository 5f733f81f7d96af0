"""Settings of the engine; the defaults are fixed values of the service it stands for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 1024
    chunk_overlap: int = 128
    chunk_merge: bool = True
    top_k: int = 6
    candidates: int = 20
    rrf_k: int = 60
    min_score: float = 0.15
    min_ratio: float = 0.5
    direct_limit: int = 6000
    retention_minutes: float = 60
    max_rounds: int = 20
    absolute_ttl_minutes: float = 720
    memo_seconds: int = 90
    dedup_seconds: int = 10
    round_seconds: int = 120
    notice_seconds: int = 600
    notices_per_session: int = 10
    retry_first_seconds: int = 30
    retry_minutes: float = 2
    retry_max: int = 30
    embed_batch: int = 64
    max_file_bytes: int = 20 * 1024 * 1024
    data_budget_bytes: int = 192 * 1024 * 1024
    unzip_bytes: int = 20 * 1024 * 1024
    text_chars: int = 2_000_000
    lexical_tokens: int = 2_000_000
    lexical_postings: int = 200_000
    lexical_global_tokens: int = 400_000
    retry_disk_bytes: int = 128 * 1024 * 1024
    summary_chars: int = 12_000
    summary_most_chars: int = 500
    summary_retry_seconds: float = 600
    summary_claim_seconds: float = 300
    audio_bytes: int = 7 * 1024 * 1024
    audio_seconds: float = 3600
    video_bytes: int = 20 * 1024 * 1024
    video_seconds: float = 600
    video_per_day: int = 20
    enable_group: bool = True
    hybrid: bool = True
    rewrite_queries: bool = True
    download_policy: str = "whitelist"
    allowed_hosts: str = "ftn.qq.com,qfile.qq.com,nt.qq.com.cn,qq.com,weixin.qq.com"

    def __post_init__(self):
        if self.chunk_size <= 0 or self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_size must be positive and above chunk_overlap")
