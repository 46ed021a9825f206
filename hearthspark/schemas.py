"""Schemas and value domains of the registry."""

from __future__ import annotations

# Spark DDL of the registry's tables.
TABLES = {
    "area_units": "id BIGINT, name STRING, type STRING, code STRING",
    "rts": "id BIGINT, area_unit_id BIGINT, number STRING",
    "religions": "id BIGINT, name STRING",
    "educations": "id BIGINT, name STRING",
    "occupations": "id BIGINT, name STRING",
    "kartu_keluarga": "id BIGINT, kk_number STRING, address STRING, rt_id BIGINT, postal_code STRING, notes STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "penduduk": "id BIGINT, kk_id BIGINT, nik STRING, full_name STRING, gender STRING, birth_place STRING, birth_date DATE, religion_id BIGINT, "
    "education_id BIGINT, occupation_id BIGINT, marital_status STRING, family_relation STRING, blood_type STRING, resident_status STRING, rt_id BIGINT, "
    "moved_at DATE, moved_destination STRING, moved_note STRING, deceased_at DATE, deceased_note STRING, notes STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "kk_anggota": "id BIGINT, kk_id BIGINT, penduduk_id BIGINT, family_relation STRING, status STRING, effective_date DATE, end_date DATE",
    "kk_photos": "id BIGINT, kk_id BIGINT, stored_filename STRING, mime_type STRING, file_size BIGINT, sha256_hash STRING, is_active BOOLEAN, uploaded_at TIMESTAMP, ocr_job_id BIGINT",
    "penduduk_documents": "id BIGINT, penduduk_id BIGINT, document_type STRING, mime_type STRING, file_size BIGINT, sha256_hash STRING, is_active BOOLEAN, uploaded_at TIMESTAMP",
    "ocr_jobs": "id BIGINT, kk_id BIGINT, source_image_hash STRING, status STRING, confidence DECIMAL(5,2), raw_text STRING, extracted_data STRING, outcome STRING, started_at TIMESTAMP, finished_at TIMESTAMP",
    "audit_logs": "id BIGINT, loggable_type STRING, loggable_id BIGINT, event STRING, old_values MAP<STRING,STRING>, new_values MAP<STRING,STRING>, created_at TIMESTAMP",
    "backup_logs": "id BIGINT, filename STRING, backup_status STRING, backup_size BIGINT, checksum STRING, started_at TIMESTAMP, finished_at TIMESTAMP",
}

# Codes in declaration order, with their labels.
GENDER = {"LAKI_LAKI": "Laki-laki", "PEREMPUAN": "Perempuan"}
RESIDENT_STATUS = {"ACTIVE": "Aktif", "PINDAH": "Pindah", "MENINGGAL": "Meninggal"}
MARITAL_STATUS = {"BELUM_KAWIN": "Belum Kawin", "KAWIN": "Kawin", "CERAI_HIDUP": "Cerai Hidup", "CERAI_MATI": "Cerai Mati"}
FAMILY_RELATION = {
    "KEPALA_KELUARGA": "Kepala Keluarga", "ISTRI": "Istri", "ANAK": "Anak", "MENANTU": "Menantu", "CUCU": "Cucu",
    "ORANG_TUA": "Orang Tua", "MERTUA": "Mertua", "FAMILI_LAIN": "Famili Lain", "LAINNYA": "Lainnya",
}
BLOOD_TYPE = ["A", "B", "AB", "O", "TIDAK_DIKETAHUI"]
MEMBERSHIP = ["AKTIF", "KELUAR"]
#: Code of each label as it is written on documents; raw codes are not labels.
LABEL_CODES = {"LAKI-LAKI": "LAKI_LAKI", "LAKI LAKI": "LAKI_LAKI", "PEREMPUAN": "PEREMPUAN"} | {c.replace("_", " "): c for c in [*MARITAL_STATUS, *FAMILY_RELATION]}
#: Age presets, both ends included; None is open.
AGE_PRESETS = {"balita": (0, 5), "anak": (6, 12), "remaja": (13, 17), "dewasa": (18, 59), "lansia": (60, None)}
#: Columns of the resident export and their headings.
EXPORT_COLUMNS = {
    "nik": "NIK", "full_name": "Nama Lengkap", "kk_number": "Nomor KK", "gender": "Jenis Kelamin", "birth_place": "Tempat Lahir", "birth_date": "Tanggal Lahir",
    "age": "Usia (th)", "rt": "RT", "area_unit": "RW", "resident_status": "Status", "religion": "Agama", "education": "Pendidikan", "occupation": "Pekerjaan",
}
