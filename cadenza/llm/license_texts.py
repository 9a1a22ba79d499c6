"""Names and public wordings of licences by family, phrases that name a licence, and paragraphs that grant nothing."""

#: Words that mark a licence. The classifier's n-grams all have one, so that prose without any is sure to be unknown.
MARKS = frozenset(
    "license licence licensed licenses licences mit apache gnu gpl lgpl agpl lesser affero bsd mozilla mpl isc boost bsl eupl eclipse epl zlib libpng cc creative commons sharealike noncommercial "
    "unlicense spdx domain copyright reserved proprietary confidential software warranty warranties redistribution redistributions redistribute redistributed disclaimer disclaimed merchantability "
    "permission permissions permitted sublicense contributors contributor foundation unencumbered waived misrepresented gplv lgplv agplv sil ofl font dual verbatim copyleft".split()
)
#: What notices call the licences.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache License", "Apache 2", "Apache-2"),
    "GPL": ("GNU General Public License", "GNU General Public License, version 3", "GPL version 2 or later", "GPL-3.0-or-later", "GNU GPL", "GPL", "GPLv3", "GPLv2+", "GPL v2", "GPLv3 or later"),
    "LGPL": (
        "GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL version 3", "LGPL-2.1-only", "GNU LGPL", "LGPL", "LGPLv3", "LGPLv2.1+"
    ),
    "AGPL": (
        "GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL version 3", "AGPL-3.0-only", "GNU AGPL", "AGPL", "AGPLv3"
    ),
    "BSD": ("BSD 3-Clause License", "2-clause BSD license", "BSD-3-Clause", "BSD license", "New BSD License", "BSD"),
    "MPL": ("Mozilla Public License, Version 2.0", "Mozilla Public License", "MPL-2.0", "MPL version 2.0", "MPL"),
    "ISC": ("ISC License", "ISC"),
    "BSL": ("Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0", "Boost license"),
    "EUPL": ("European Union Public Licence", "EUPL, Version 1.2", "EUPL-1.2", "EUPL"),
    "EPL": ("Eclipse Public License 2.0", "Eclipse Public License", "EPL-2.0", "EPL"),
    "Zlib": ("zlib license", "zlib", "zlib/libpng license"),
    "OFL": ("SIL Open Font License, Version 1.1", "SIL Open Font License", "Open Font License 1.1", "OFL-1.1", "SIL OFL"),
    "CC-BY": (
        "CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "CC-BY-4.0", "CC BY 3.0"
    ),
    "CC-BY-SA": (
        "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike license",
        "CC-BY-SA-4.0", "CC BY-SA 3.0"
    ),
    "CC-BY-NC": (
        "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial license",
        "CC-BY-NC-4.0", "CC BY-NC 3.0"
    ),
    "Public-Domain": ("CC0 1.0", "CC0 1.0 Universal", "CC0", "Unlicense", "CC0-1.0", "public domain dedication"),
}
#: Names of what is no licence of works, for the same phrases.
OTHER_NAMES = (
    "old name of the town", "bridge", "rules of the county", "new management", "fishing rules of the lake", "liquor act", "harbour law",
    "general rules of the house", "name of his sister", "public eye",
    "creative direction of the theatre", "age of ten", "common roof of the market", "attribution of the painting", "version of the story",
    "first boost of the season", "open sky of the north", "font of the old church", "dual use rules of the harbour", "verbatim record of the court",
)
#: Phrases that name a licence.
PHRASES = (
    "Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.", "Distributed under the terms of the {}.",
    "SPDX-License-Identifier: {}",
    "This work is licensed under a {}.", "Available under {}, see the file LICENSE.", "The code is made available under the {}.", "License: {}",
    "Text is available under {}.",
    "Copyright 2020 by the authors. Published under {}.", "This library is licensed under {}.",
    "Use of this is governed by the {} that can be found in the file.",
    "You may use this under {}.", "{} licensed.", "(c) 2019, released under {}", "Dual licensed under {} and a commercial one.",
)
#: Short notices, and the paragraphs of the licences' own texts and of the notices that they ask for.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Distributed under the terms of the MIT license, see the file LICENSE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, "
        "irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or "
        "Object form.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2.",
        "Licensed under the GPL version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright "
        "notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the absence of any "
        "warranty; and give all recipients a copy of this License along with the Program.",
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an "
        "appropriate copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of the "
        "Program a copy of this License along with the Program.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU Lesser General Public License.",
        "Licensed under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Lesser General Public License for more details.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU Affero General Public License.",
        "Licensed under the AGPL version 3 or later.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Licensed under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Licensed under the ISC license.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "BSL": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "Licensed under the Boost Software License.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, "
        "display, distribute, execute, and transmit the Software",
    ),
    "EUPL": (
        "Licensed under the EUPL, Version 1.2.",
        "Licensed under the European Union Public Licence.",
        "SPDX-License-Identifier: EUPL-1.2",
        "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL; you may not use this work except in compliance with the "
        "Licence.",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "Zlib": (
        "Released under the zlib license.",
        "SPDX-License-Identifier: Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    "OFL": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified "
        "copies of the Font Software, subject to the following conditions:",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the Creative Commons Attribution license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Released under the Creative Commons Attribution ShareAlike license.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the Creative Commons Attribution NonCommercial license.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under CC0 1.0.",
        "Dedicated to the public domain under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
        "This document is confidential and proprietary and may not be copied or disclosed without the express written consent of the company.",
    ),
}
#: Paragraphs that have a licence's words but grant nothing.
OTHERS = (
    "He renewed his driving license at the county office last week.", "The pilot lost her licence after the hearing.",
    "The license plate of the van was covered in mud.", "You need a licence to keep a dog in this town.",
    "The course on copyright law begins in spring.", "She asked permission to leave the table early.",
    "The warranty of the new washing machine lasts two years.", "A warrant was issued for his arrest.",
    "The poem has long been in the public domain, says the museum.", "Food was redistributed among the villages after the flood.",
    "Poetic license let the author move the battle to the coast.", "The teacher gave the class permission to read the work in the garden.",
    "The apache helicopters crossed the valley at dawn.", "Students of the mit campus walked along the river.",
    "The general public may visit the library on sundays.", "A version of the story was released in the spring.",
    "The council voted to reserve all seats for residents of the district.", "Fishing without a license is fined under the local rules.",
    "The bar lost its liquor licence and closed.", "The creative class left the commons to the sheep.",
    "The contract was terminated and the parties agreed to the conditions of the notice.",
    "Damages were awarded to the author of the book by the court in the action.",
    "The software was slow and the documentation of the program was a copy of an older file.",
    "The names of the contributors appear in the list at the end of the book.", "Any person may use the path for any purpose, with or without a dog.",
    "The foundation published the terms of the prize, and the notice was included in all the papers.",
    "The boost in sales was seen by the european commission in the union budget.",
    "The eclipse was seen by the public, and materials were made available to the school.",
    "All rights to the front seats are reserved for guests of the house.", "Rights of way over the field are reserved for the farmers.",
    "All tables are reserved for the wedding on saturday.", "The rights reserved to the states were argued in the court.",
    "All seats reserved for members.", "All places reserved.", "Rights to the water are reserved.",
    "The archive was compressed with zlib before it was sent.", "A zlib compressed file was on the disk.", "The program links against zlib and reads old archives.",
    "The gnu drank at the river with the zebras.", "He bought a boost for the child seat and a compressed bag.", "They met at the isc meeting in the spring.",
    "The font of the book was open and easy to read.", "The dual carriageway was licensed for lorries.",
)
