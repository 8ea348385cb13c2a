"""Frame change detection on Spark: keyframes, masks, hashes and manifests as DataFrame plans."""
