"""A hand-written upload corpus: three files, eight functions."""

import json

VECTORS = {"f1": ("A", "00401000", {"a": 2, "b": 1}), "f2": ("A", "00401100", {"a": 2, "b": 1}), "f3": ("B", "00402000", {"a": 1, "b": 1}), "f4": ("B", "00402100", {"b": 3}), "f5": ("C", "00403000", {"z": 5}), "f6": ("C", "00403100", {}), "f7": ("C", "00403200", {"a": 1}), "f8": ("C", "00403300", {"a": 1})}
LINES = {"f1": [["int", " ", "x"], ["x", "=", "1"], ["\t"], ["return", "x"]], "f2": [["int", " ", "x"], ["y", "=", "2"], ["return", "x"]]}


def function(name):
    file, address, tf = VECTORS[name]
    raw = [h for h, n in tf.items() for _ in range(n)]
    lines = LINES.get(name, [[name]])
    tokens, k = [], 0
    for i, line in enumerate(lines):
        for t in line:
            tokens.append({"t": t, "type": None if t.isspace() else "text", "line": i, "addr": f"{address}{k}", "pcode_time": k, "seq": f"s{k}"})
            k += 1
    meta = [
        {"hash": h, "type": "COPY_SIG" if j else "DATA_FLOW", "pcode_op": "COPY", "line_idx": [1] if name in LINES else [0], "seq_to_token_idx": [], "addr_to_token_idx": [3, 4] if j else 3, "seq": f"q{j}", "block_index": 0,
         "pcode_block": {"q": "COPY"} if j else [], **({} if j else {"addr": address})}
        for j, h in enumerate(raw)
    ]
    return {
        "function_metadata": {"type": "function", "function_name": name, "file_md5": file, "file_name": f"{file}.bin", "batch_uuid": "b1", "language_id": "x86", "full_id": f"{file}:#{file}::{name}:@{address}", "tags": ["t"], "labels": [], "instruction_count": 9, "is_thunk": name == "f6", "bsim_features_count": len(raw), "bsim_unique_features_count": len(tf), "entry_date": 1_700_000_000_000},
        "function_source": {"c_lines": ["".join(x) for x in lines], "c_tokens": tokens, "addr_to_line": {}, "addr_to_token": {}, "seq_to_token": {}, "line_to_token": {}, "line_to_addr": {str(i): [f"{address}L{i}"] for i in range(len(lines))}},
        "function_features": {"bsim_features_meta": meta, "bsim_features_raw": raw, "bsim_features_tf": [{"hash": h, "tf": n} for h, n in sorted(tf.items(), key=lambda x: (-x[1], x[0]))], "bsim_features_count": len(raw), "bsim_unique_features_count": len(tf)},
    }


def write(folder):
    """One JSON file for each binary; returns the folder."""
    for k, file in enumerate("ABC"):
        doc = {
            "collection": "main", "file_md5": file,
            "file_metadata": {"entry_date": 1_700_000_000_000 + k, "file_date": 1, "file_md5": file, "file_name": f"{file}.bin", "batch_uuid": "b1" if file < "C" else "b2", "batch_name": "first", "batch_order": k, "tags": ["t"], "language_id": "x86", "file_id": f"{file}:#{file}"},
            "functions": [function(n) for n, v in VECTORS.items() if v[0] == file],
        }
        (folder / f"{file}.json").write_text(json.dumps(doc, indent=1))
    return str(folder)
