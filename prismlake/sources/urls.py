"""Where the public datasets' archives are."""

from __future__ import annotations

import os

from .images import check_category, fetch, unpack

# Archive addresses by source and category.
VISA_ARCHIVE = "https://amazon-visual-anomaly.s3.us-west-2.amazonaws.com/VisA_20220922.tar"
ARCHIVES = {
    "mvtec_ad": {
        "bottle": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420937370-1629958698/bottle.tar.xz",
        "cable": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420937413-1629958794/cable.tar.xz",
        "capsule": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420937454-1629958872/capsule.tar.xz",
        "carpet": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420937484-1629959013/carpet.tar.xz",
        "grid": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420937487-1629959044/grid.tar.xz",
        "hazelnut": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420937545-1629959162/hazelnut.tar.xz",
        "leather": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420937607-1629959262/leather.tar.xz",
        "metal_nut": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420937637-1629959294/metal_nut.tar.xz",
        "pill": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420938129-1629960351/pill.tar.xz",
        "screw": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420938130-1629960389/screw.tar.xz",
        "tile": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420938133-1629960456/tile.tar.xz",
        "toothbrush": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420938134-1629960477/toothbrush.tar.xz",
        "transistor": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420938166-1629960554/transistor.tar.xz",
        "wood": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420938383-1629960649/wood.tar.xz",
        "zipper": "https://www.mydrive.ch/shares/38536/3830184030e49fe74747669442f0f283/download/420938385-1629960680/zipper.tar.xz",
    },
    "mvtec_loco": {
        "breakfast_box": "https://www.mydrive.ch/shares/48238/d94999f7d56b82c26cc22e36a8cfe02b/download/430647124-1646843193/breakfast_box.tar.xz",
        "juice_bottle": "https://www.mydrive.ch/shares/48239/3ad28d48636eada48f0caded666a804a/download/430647100-1646843074/juice_bottle.tar.xz",
        "pushpins": "https://www.mydrive.ch/shares/48240/e1942c84f417afccee149ef5121846c1/download/430647097-1646843009/pushpins.tar.xz",
        "screw_bag": "https://www.mydrive.ch/shares/48241/be5dc3a69c92932644aaac945451d4e7/download/430647115-1646843129/screw_bag.tar.xz",
        "splicing_connectors": "https://www.mydrive.ch/shares/48242/9202635b7b15beba2ceea1674c7deebc/download/430647132-1646843288/splicing_connectors.tar.xz",
    },
    "mvtec_ad2": {
        "can": "https://www.mydrive.ch/shares/121501/26456e2f3ef813930866f8f9b072593a/download/466651130-1743159807/can.tar.gz",
        "fabric": "https://www.mydrive.ch/shares/121502/812590f745083da1f5edb338a6c321c4/download/466651519-1743160379/fabric.tar.gz",
        "fruit_jelly": "https://www.mydrive.ch/shares/121503/951a46ce30a3af3787ce9671cfa8613a/download/466651800-1743164023/fruit_jelly.tar.gz",
        "rice": "https://www.mydrive.ch/shares/121504/0014676292c3c44931712a54fb3bdbe8/download/466653907-1743164943/rice.tar.gz",
        "sheet_metal": "https://www.mydrive.ch/shares/121505/2d8fcdc8e988456bdd18696746eda0a0/download/466654829-1743166795/sheet_metal.tar.gz",
        "vial": "https://www.mydrive.ch/shares/121506/739dc6459c939fe464c0d26acc6c2d55/download/466654885-1743167505/vial.tar.gz",
        "wallplugs": "https://www.mydrive.ch/shares/121507/66fe6e114b498e03be8d48c711794be7/download/466655287-1743168151/wallplugs.tar.gz",
        "walnuts": "https://www.mydrive.ch/shares/121508/9fcf67e49f0dc61a9608f57ba0482356/download/466656233-1743168988/walnuts.tar.gz",
    },
}


def archive_of(source: str, category: str) -> str:
    check_category(source, category)
    return VISA_ARCHIVE if source.lower() == "visa" else ARCHIVES[source.lower()][category]


def download(source: str, category: str, folder: str) -> str:
    """Fetch and unpack a category's archive unless its folder is there; returns the folder of the data."""
    url = archive_of(source, category)
    target = folder if source.lower() == "visa" else os.path.join(folder, category)
    if not os.path.isdir(target) or not os.listdir(target):
        os.makedirs(folder, exist_ok=True)
        unpack(fetch(url, os.path.join(folder, os.path.basename(url))), folder)
    return target
