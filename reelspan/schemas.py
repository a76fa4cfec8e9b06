"""Explicit schemas of the relations."""

OPTIONS = "struct<max_clips:int,content_profile:string,crop_bias:string,download_only:boolean>"
JOBS = f"id string, youtube_url string, youtube_id string, video_title string, video_duration_s double, submitted_at timestamp_ntz, state string, current_stage string, last_stage_completed string, error_message string, retry_count int, options {OPTIONS}, completed_at timestamp_ntz, failed_at timestamp_ntz, cancelled_at timestamp_ntz, _corrupt_record string"
CLIPS = "id string, job_id string, start_s double, end_s double, score double, transcript_snippet string, status string, created_at timestamp_ntz, file_path string"
POSTS = "id string, clip_id string, platform string, status string, posted_at timestamp_ntz, post_url string, error string, retry_count int"
SEGMENTS = "video_id long, seg_idx int, start double, end double, text string"
COMMENTS = "video_id long, comment_id long, text string, like_count int, timestamps array<int>"
FRAMES = "video_id long, frame_idx int, t double, rms double, zcr double"
WORDS = "video_id long, clip_idx int, word_idx int, word string, start double, end double"
COMMENT_PAGE = "items array<struct<snippet:struct<topLevelComment:struct<snippet:struct<textDisplay:string,textOriginal:string,likeCount:int>>>>>, nextPageToken string"
